"""The corpus operators against brute force on small tables with awkward rows."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest

from volspark.llm import chat, exact_dedup, fingerprint, language, mixing, ngram_join, packing, quality, registry, substring_dedup, toxicity
from volspark.llm.common import word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, n long, h string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 0.5, 7, "y") for i, t, s in rows], SCHEMA)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünï", "x"]) + str(rng.randrange(40)) for _ in range(60)) for _ in range(6)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(10, base[0], "s1"), (11, base[0].replace(" ", "\t"), None), (12, base[1].upper(), "s0"), (13, base[2] + " tail words here", "s2")]
    rows += [(14, None, "s0"), (15, "", None), (16, " \n\t", "s1"), (17, "one", "s1"), (18, "one", "s1"), (19, "two words", "s2"), (20, base[3][:200] + " cut " + base[4], "s0")]
    rows += [(21, "long " * 3000 + base[5], "s0"), (21, "long " * 3000 + base[5], "s0"), (22, "w" * 30_000, "s1"), (23, "a b \U0001f600 c", "s1")]
    return rows


def test_word_hashes_do_not_depend_on_place():
    texts = [b"a bb  a", b"", b"bb", b"x" * (1 << 19) + b" a", b" a " * 200_000]
    h, n = word_hashes(texts)
    assert n.tolist() == [3, 0, 1, 2, 200_000]
    assert h[0] == h[2] == h[5] == h[6] and h[1] == h[3] and len(set(h[:6].tolist())) == 3


@pytest.mark.parametrize("table_bytes", [1 << 20, 300])
def test_exact_dedup(spark, awkward, table_bytes):
    got = exact_dedup.exact_dedup(frame(spark, awkward), table_bytes).collect()
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in got:
        group = [(-len(t or ""), i) for i, t, _ in awkward if bare(t) == bare(next(t for i, t, _ in awkward if i == r["doc_id"]))]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(group)[1], len(group), min(group)[1] == r["doc_id"])
    assert len(got) == len(awkward)


def test_grace_spills_and_recurses():
    rows = [(int.from_bytes(hashlib.blake2b(b"%d" % (i % 50), digest_size=16).digest(), "big"), b"%d" % (i % 50), 1, i, 1, 1) for i in range(500)]
    groups = dict(exact_dedup.grace(iter(rows), 500))
    assert len(groups) == 50 and all(v[2] == 10 and v[1] < 50 for v in groups.values())


def test_substring_dedup(spark, awkward):
    rows = {}
    for i, t, _ in awkward:
        rows.setdefault(i, words(t))
    seen = {}
    for i in sorted(rows):
        for k in range(len(rows[i]) - 12):
            seen.setdefault(tuple(rows[i][k : k + 13]), i)
    for r in substring_dedup.substring_dedup(frame(spark, awkward), keep_text=True).collect():
        w = rows[r["doc_id"]]
        gone = {k + j for k in range(len(w) - 12) if seen[tuple(w[k : k + 13])] < r["doc_id"] for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest() and sum(b - a for a, b in r["repeats"]) == len(gone)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_of_few_words(spark, seed):
    """Texts of three words only, so that windows, anchors and documents repeat in all ways; ids repeat and are null."""
    rng, n = random.Random(seed), 5
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))), "s") for _ in range(60)]
    key = lambda i: 1 << 62 if i is None else i
    seen = {}
    for i, t, _ in sorted(rows, key=lambda r: key(r[0])):
        w = t.split()
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), key(i))
    want = []
    for i, t, _ in rows:
        w = t.split()
        gone = {k + j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] < key(i) for j in range(n)}
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r["doc_id"], r["kept_text"]) for r in substring_dedup.substring_dedup(frame(spark, rows), n, 2, keep_text=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_components(rows, percent=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_ngram_join(spark, awkward):
    got = ngram_join.ngram_join(frame(spark, awkward)).collect()
    want = brute_components([(i, t) for i, t, _ in awkward])
    assert len(got) == len(awkward) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_of_edited_copies(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(120):
        w = list(base) if i % 3 else [rng.choice(vocabulary) for _ in range(40)] + base[:60]
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w), "s"))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components([(i, t) for i, t, _ in rows]).items()}


def units(text):
    """Parts of a text, each with the number of its repeat."""
    seen, out = {}, set()
    zones = text[: fingerprint.HEAD], text[fingerprint.HEAD :]
    for x in [x for z, p in zip(zones, fingerprint.PARTS, strict=True) for x in re.findall(p, z)]:
        out.add((x, seen.setdefault(x, 0)))
        seen[x] += 1
    return out


def test_fingerprints(spark, awkward):
    rows = sorted({(i, t or "") for i, t, _ in awkward})
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark, awkward)).collect()}
    alike = lambda a, b: len(units(a) & units(b)) / len(units(a) | units(b)) if units(a) | units(b) else 1.0
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(t, edited)) and r["near_next"] == pytest.approx(alike(t, after))
    assert got[17]["fingerprint"] == got[18]["fingerprint"]
    assert fingerprint.fingerprints(frame(spark, awkward)).count() == len(awkward)


@pytest.mark.parametrize("share", [1.2, 0.05])
def test_fingerprints_recover_digests(spark, monkeypatch, share):
    """Sketches that start far too small are retried until both sets of digests are recovered."""
    monkeypatch.setattr(fingerprint, "SHARE", share)
    rng = random.Random(2)
    rows = [(i, "\n".join(f"p{rng.randrange(30)}" for _ in range(rng.randrange(40))), "s") for i in range(12)]
    rows += [(None, "no id", "s"), ((1 << 63) - 1, "largest", "s"), (3, "same id", "s")]
    docs = frame(spark, rows)
    texts = spark.createDataFrame([(t,) for _, t, _ in rows], "text string")
    digests = {r["text"]: set(r["d"]) for r in texts.select("text", fingerprint.digests(texts.text).alias("d")).collect()}
    h = {r["text"]: r["h"] for r in texts.selectExpr("text", "xxhash64(text) h").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, h[r[1]]))
    want = [(i, len(t), sorted(digests[t] - digests[u]), sorted(digests[u] - digests[t])) for (i, t, _), (_, u, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True)]
    got = fingerprint.fingerprints(docs, keep_digests=True).collect()
    assert sorted(want, key=str) == sorted([(r["doc_id"], r["n_chars"], sorted(r["only_here"]), sorted(r["only_next"])) for r in got], key=str)


def test_likeness_does_not_depend_on_length_classes(spark):
    """Versions whose lengths lie around 128 and 1,024 characters, with one character put in front, and with repeated lines."""
    rng = random.Random(8)
    rows = []
    for size in (126, 128, 130, 1020, 1023, 1024, 1030, 1184, 5000):
        text = " ".join("".join(rng.choice("abcdefhilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(size))[:size]
        rows += [(4 * len(rows) + k, t, "s") for k, t in enumerate((text, "x" + text, text[:-1] + "yy", "end"))]
    rows.append((1000, "again and again\n" * 300 + "the end of it", "s"))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        if len(t) >= 400:
            assert got[i]["near_edited"] >= 0.4
    for i, t, _ in rows[:-1:4]:
        if len(t) >= 1000:
            assert got[i]["near_next"] > 0.4 and got[i + 1]["near_next"] > 0.4
        else:
            assert got[i]["near_next"] > 0.2


def test_fingerprint_of_one_document(spark):
    (r,) = fingerprint.fingerprints(frame(spark, [(5, "abcdefgh", "s")])).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_packing_places_every_token(spark, awkward):
    got = packing.pack_documents(frame(spark, awkward), capacity=64, keep_ids=True, **registry.tokenizer()).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 64
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(registry.tokenizer()["json_path"])
    by_doc = got.drop_duplicates(["doc_id", "piece"]).sort_values(["doc_id", "piece"]).groupby("doc_id")
    for i, t, _ in awkward:
        g = by_doc.get_group(i)
        ids = [int.from_bytes(x[k : k + 4], "little") for x in g["ids"] for k in range(0, len(x), 4)]
        assert ids == [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert (g["length"].iloc[1:] == 64).all() and g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]


def brute_bins(items, capacity):
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[k] <= capacity:
                bins[j] += items[k]
                go(k + 1, bins)
                bins[j] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_when_small(seed):
    rng = random.Random(seed)
    items = sorted((rng.randrange(3, 40) for _ in range(10)), reverse=True)
    counts = {s: items.count(s) for s in items}
    plan = packing.solve(counts, 50)
    assert sorted(s for f, n in plan for s in f * n) == sorted(items) and all(sum(f) <= 50 for f, _ in plan)
    assert sum(n for _, n in plan) == brute_bins(items, 50)


def test_bin_completion_backtracks_over_many_pieces():
    rng, counts = random.Random(6), {}
    for _ in range(8):
        a = rng.randrange(50, 100)
        b = rng.randrange(50, min(100, 160 - a))
        for s in (a, b, 200 - a - b):
            counts[s] = counts.get(s, 0) + 60
    plan = packing.solve(counts, 200)
    placed = [s for f, n in plan for s in f * n]
    assert {s: placed.count(s) for s in counts} == counts and all(sum(f) <= 200 for f, _ in plan)
    assert sum(n for _, n in plan) == 480


def test_packing_meets_the_bound_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack_documents(docs, **registry.tokenizer()).toPandas()
    counts = got["length"].value_counts().to_dict()
    assert got.sequence_id.nunique() == packing.waste_bound(counts, packing.CAPACITY) and got.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY


def test_documents_are_encoded_alike(spark):
    paths = registry.tokenizer()
    both = packing.encoder(*paths.values()), packing.encoder(paths["json_path"], None, None)
    for (text,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert both[0](text or "") == both[1](text or "")


def test_special_strings_are_encoded_alike():
    paths = registry.tokenizer()
    both = packing.encoder(*paths.values()), packing.encoder(paths["json_path"], None, None)
    for s in ("plain it's 12", "a <|endoftext|> b", "tab\t\n  x", "Ünï \U0001f600"):
        assert both[0](s) == both[1](s)


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(0, 30), [None, "a", "b", "c"][min(rng.randrange(8), 3)]) for i in range(400)]
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and len(got) == 400
    per = got.merge(frame(spark, rows).select("doc_id", "source").toPandas(), on="doc_id").groupby("source", dropna=False).agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (abs(per.taken - per.target) <= 31).all() and per.target.sum() == pytest.approx(1.5 * per.source_size.sum())
    assert (per.target <= 2 * per.source_size + 1e-6).all()
    assert mixing.mixed_rows(frame(spark, rows)).count() == (got.taken / got["size"].clip(lower=1)).sum()


def test_rows_without_ids_and_with_repeated_ids(spark):
    """Every row has a result of its own, whatever its id."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(i, text(k), "s") for k, i in enumerate([None, None, None, 7, 7, 8])] + [(None, text(0), "s"), (7, text(3), None)]
    docs = frame(spark, rows)
    exact = exact_dedup.exact_dedup(docs).toPandas()
    assert len(exact) == 8 and sorted(exact.group_size) == [1, 1, 1, 1, 2, 2, 2, 2] and exact.kept.sum() >= 6
    joined = ngram_join.ngram_join(docs).collect()
    assert len(joined) == 8 and {r["component_id"] for r in joined if r["doc_id"] is not None} == {7, 8}
    mixed = mixing.mix(docs).toPandas()
    assert len(mixed) == 8 and abs(mixed.taken.sum() - 1.5 * 240) <= 30 and (mixed.taken <= 60).all()
    out = mixing.mixed_rows(docs)
    assert out.filter("doc_id IS NULL").count() > 0
    packed = packing.pack_documents(docs, capacity=256, **registry.tokenizer()).toPandas().sort_values(["sequence_id", "offset"])
    assert packed[packed.start == 0].shape[0] == 8 and (packed.groupby("sequence_id").length.cumsum() - packed.length == packed.offset).all()
    assert fingerprint.fingerprints(docs).count() == 8


def test_language_needs_letters(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(9)] + [(20, "²½ 12", None), (None, "cat on mat", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert got[20] == "und" and got[None] == "en"


def test_chat_round_trip(spark):
    texts = ["plain", None, "", chat.PROBE, "<\\|im_end|> <|", "<nl|", "a\nb", "<|im_end|>\n<|im_start|>user\nx", "<", "|im_end|>"]
    rows = [(c, t, "assistant" if t % 2 else "user", x) for c in range(3) for t, x in enumerate(texts[c:])] + [(9, 0, "odd\nrole<nl|", "x"), (9, 0, "odd\nrole<nl|", "x"), (None, None, None, None)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(chat.with_probe(spark, conversations))
    assert formatted.filter("NOT exact").isEmpty()
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert got[-1]["loss_sha256"] == hashlib.sha256(chat.PROBE.encode()).hexdigest() and got[9]["n_turns"] == 2 and got[9]["escaped"]
    for r in formatted.filter("conv_id IS NOT NULL").collect():
        spoken = [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        cut = [r["formatted"][m["start"] : m["end"]] for m in r["mask"]]
        assert [re.sub(r"<\\(\\*)(nl)?\|", lambda m: f"<{m[1]}{m[2] or ''}|", x) for x in cut] == spoken and all(r["formatted"][m["end"] :].startswith("<|im_end|>\n") for m in r["mask"])
    loss = "".join((x or "") for t, x in enumerate(texts) if t % 2)
    assert got[0]["loss_chars"] == len(loss) and got[0]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_field_marginals_equal_the_full_chain():
    import numpy as np

    field = toxicity.Field([b"=bad", b"=ugly"])
    field.weights, field.bias, field.transitions, field.ready = np.array([2.0, 1.0]), -1.5, np.array([[0.5, -0.4], [-0.3, 0.8]]), True
    text = b"so bad bad and ugly it is " + b"on and on " * 4 + b"bad"
    states = toxicity.tokens(text)
    e = np.array([field.bias + sum(field.weights[i] for i in field.known(w)) for w in states])
    p, _ = toxicity.chain_marginals(e[None], field.transitions, np.ones((1, len(e)), bool))
    for i, x in field.tag(text)[1]:
        assert x == pytest.approx(p[0, i], abs=1e-9)
    small = e[:8]
    total, hit = 0.0, np.zeros(8)
    for s in itertools.product((0, 1), repeat=8):
        w = np.exp(sum(small[k] * s[k] for k in range(8)) + sum(field.transitions[s[k], s[k + 1]] for k in range(7)))
        total += w
        hit += w * np.array(s)
    assert np.allclose(toxicity.chain_marginals(small[None], field.transitions, np.ones((1, 8), bool))[0][0], hit / total)


def test_spans_are_code_points():
    text = "Ünï badé x"
    raw = text.encode()
    (span,) = toxicity.spans(raw, [(1, 0.9)])
    assert text[span["start"] : span["end"]] == "badé"


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_held_out_accuracy(labelled):
    docs, labels = labelled
    got = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_quality_equations_by_brute_force(spark):
    """The ridge weights from the summed equations, and that neither the order nor the files of the rows matter."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["good", "words", "here", "!!!", "x|y"][: 3 + 2 * (i % 2)]) for _ in range(rng.randrange(5, 60)))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    frame_of = lambda r, n: spark.createDataFrame(r, "doc_id long, text string").repartition(n)
    stats = {i: quality.statistics(t.encode()) for i, t in rows}
    models = []
    for r, n in ((rows, 2), (rows[::-1], 7)):
        frame = frame_of(r, n).mapInArrow(quality._statistics, "doc_id long, x array<double>")
        models.append(quality.fit(frame, labels, "quality"))
    h = {r["doc_id"]: r["h"] for r in spark.range(400).selectExpr("id AS doc_id", "pmod(xxhash64(id), 1 << 20) AS h").collect()}
    seen = [i for i in range(400) if h[i] % quality.CALIBRATE]
    z, y = models[0].features(np.array([stats[i] for i in seen])), np.array([i % 2 for i in seen])
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(seen) * np.eye(z.shape[1]), z.T @ y)
    for m in models:
        assert np.allclose(z @ m.weights, z @ want, atol=1e-6)
    assert np.allclose(models[0].steps[1], models[1].steps[1])


def test_isotonic_by_brute_force():
    rng = np.random.default_rng(9)
    x, y, w = rng.permutation(40).astype(float), rng.random(40), rng.integers(1, 5, 40).astype(float)
    at, fit = quality.isotonic(x, y, w)
    o = np.argsort(x)
    mean = lambda a, b: (y[o][a:b] * w[o][a:b]).sum() / w[o][a:b].sum()
    want = [max(min(mean(a, b) for b in range(k + 1, 41)) for a in range(k + 1)) for k in range(40)]
    assert np.allclose(np.interp(np.sort(x), at, fit), want)


def test_quality_statistics_cover_all_words():
    at = lambda text: dict(zip(quality.NAMES, quality.statistics(text.encode()), strict=True))
    for n in (500, 5000):
        assert at("cell cell| " * n)["word_ends"] == at("cell| cell " * n)["word_ends"] == 0.5
    passage = "a b c d e f g h i "
    assert at(passage + "j k l m n o p q r s")["block_repeats"] == 0
    assert at(passage * 2)["block_repeats"] == 6 / 15 and at(passage + "x " + passage)["block_repeats"] == 6 / 16


def test_language_held_out_accuracy(labelled):
    docs, _ = labelled
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98


def test_toxicity_held_out_english(labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.filter("lang = 'en'").select("doc_id"), "doc_id").filter("held_out").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.8 and got[got.toxic == 0].predicted.mean() < 0.03


def test_toxicity_held_out_by_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels).drop("spans").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    recall = got[got.toxic == 1].groupby("lang").predicted.mean()
    assert set(recall.index) == {"de", "en", "es", "fr"} and recall.min() > 0.75
    assert got[got.toxic == 0].groupby("lang").predicted.mean().max() < 0.03


def test_toxicity_learns_from_the_whole_table(spark, monkeypatch):
    """Toxic words that stand late in a table with more segments than the fit takes, and a long document before them."""
    monkeypatch.setattr(toxicity, "SEGMENTS", 60)
    rng = random.Random(5)
    text = lambda bad: " ".join([*(f"w{rng.randrange(300)}" for _ in range(60)), bad, "end"])
    rows = [(0, " ".join(f"w{rng.randrange(300)} rudeword" for _ in range(4000)))]
    rows += [(i, text(("rudeword" if i < 200 else "vilephrase") if i % 2 else "plain")) for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    labels = spark.createDataFrame([(i, int(i % 2 == 1 or i == 0)) for i, _ in rows], "doc_id long, toxic int")
    field = toxicity.learn(docs, labels, "toxic")
    assert all(field.weights[i] > 0 for i in field.index.values())
    assert field.tag(text("vilephrase").encode())[0] > 0.7 and field.tag(text("rudeword").encode())[0] > 0.7


def test_classifiers_on_awkward_and_empty_tables(spark, awkward):
    docs = frame(spark, [*awkward, (None, "text without id", "s0")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(docs, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert found[14] == found[15] == found[16] == "und" and found[17] == "en"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        quality.quality(docs, labels), language.identify(docs), toxicity.toxicity(docs, labels), exact_dedup.exact_dedup(docs), substring_dedup.substring_dedup(docs),
        ngram_join.ngram_join(docs), fingerprint.fingerprints(docs), packing.pack_documents(docs, **registry.tokenizer()), mixing.mix(docs),
    ):
        assert df.count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    a, b = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(b.columns)
    rows = [sorted(map(tuple, x[columns].astype(str).to_numpy().tolist())) for x in (a, b)]
    assert sorted(a.columns) == columns and rows[0] == rows[1]


def test_language_learns_rows_without_ids_once(spark):
    """Thousands of copies without a doc_id don't take a dictionary over."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "mat", "dog", "ran"]) for _ in range(40)), "en") for i in range(400)] + [(None, "zzzz qqqq " * 20, "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = language.learn(docs).contents["en"]
    assert content.count(b"zzzz") < 0.1 * content.count(b"the")


def test_plain_segments_of_long_toxic_texts():
    """Segments of a text of a million words, most of them with a feature, take linear time."""
    import time

    import pyarrow as pa

    field = toxicity.Field([b"=bad"])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["bad word " * 500_000 + "clean " * 100]), pa.array([1])], names=["doc_id", "text", "y"])
    began = time.process_time()
    (out,) = toxicity._segments(iter([batch]), field)
    assert time.process_time() - began < 30 and [] in out.column(2)[-1].as_py()


def test_statistics_of_long_texts():
    """Statistics hold for words, not for copies of them: a text of a million words."""
    x = dict(zip(quality.NAMES, quality.statistics(b"one two three four " * 250_000), strict=True))
    assert x["word_repeats"] == pytest.approx(1 - 4 / 1e6) and x["block_repeats"] == pytest.approx(1 - 4 / (1e6 - 3)) and x["word_runs"] == 0 and x["word_ends"] == 0


def test_hot_rows_without_ids(spark):
    """A third of all rows are one text without an id; every row keeps its own result."""
    rows = [(i, f"text number {i} with words {i % 7}", "s") for i in range(200)] + [(None, "the same text", None)] * 100
    docs = frame(spark, rows)
    exact = exact_dedup.exact_dedup(docs).filter("doc_id IS NULL").collect()
    assert len(exact) == 100 and {(r.keep_id, r.group_size, r.kept) for r in exact} == {(None, 100, True)}
    joined = ngram_join.ngram_join(docs).filter("doc_id IS NULL").collect()
    assert len(joined) == 100 and {r.component_id for r in joined} == {None}
    packed = packing.pack_documents(docs, **registry.tokenizer())
    assert packed.filter("doc_id IS NULL").count() == 100 and packed.select("sequence_id", "offset").distinct().count() == 300


def test_mix_is_sorted_by_finish(spark):
    rows = [(i, "word " * (1 + i % 9), f"s{i % 2}") for i in range(300)]
    found = mixing.mix(frame(spark, rows)).collect()
    times = [r.mix_finish for r in found]
    taken = [t for t in times if t is not None]
    assert taken == sorted(taken) and times[: len(taken)] == taken and all((r.taken > 0) == (r.mix_finish is not None) for r in found)
