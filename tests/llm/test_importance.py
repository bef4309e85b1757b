"""Importance resampling against strings and zlib."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from volspark.llm import importance

SCHEMA = "doc_id long, text string, bucket long, n string, score string, part string, weight string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", "w") for i, t in rows], SCHEMA)


def brute(rows, target, orders=2, least=20, percent=25):
    def features(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]

    of = [features(t) for _, t in rows]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, b in of:
        np.add.at(s, b, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    big_s, big_t = int(s.sum()), int(t.sum())
    out = []
    for (i, _), (n, b) in zip(rows, of, strict=True):
        gain = [math.floor(1000 * math.log((int(t[k]) + 1) * (big_s + 10_000) / ((int(s[k]) + 1) * (big_t + 10_000)))) for k in b]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = [(*r, k + 1 if k < len(may) * percent // 100 else None) for k, r in enumerate(may)]
    return sorted(map(repr, ranks + [(*r, None) for r in out if r[1] < least]))


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_awkward_documents(spark, orders):
    rng = random.Random(4)
    word = lambda: rng.choice(["Alpha", "beta", "ÜNÏ", "ünï", "x1", "\U0001f600", "gamma" * 20, "z" * 64]) + rng.choice(["", str(rng.randrange(30))])
    rows = [(i, rng.choice([" ", ", ", "\x00", "\n"]).join(word() for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "!!! ..."), (None, "alpha beta " * 15), (None, "alpha beta " * 15), (3, rows[3][1]), (3, rows[3][1]), (80, "w" * 3_000_000 + " tail"), (81, "long words here " * 100_000)]
    target = ["alpha beta gamma", "x1 x2 ünï", None, ""]
    got = importance.resample(frame(spark, rows), frame(spark, list(enumerate(target))), orders=orders).collect()
    found = sorted(repr((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in got)
    assert found == brute(rows, target, orders)


def test_shifts_compose_checksums():
    shift, rng = importance.Shifts(), random.Random(1)
    for size in (0, 1, 7, 63, 64, 65, 1000, 100_003):
        a, b = rng.randbytes(9), rng.randbytes(size)
        assert int(shift(np.array([zlib.crc32(a)], np.uint32), np.array([size]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_words_do_not_depend_on_parts(monkeypatch):
    text = " ".join(random.Random(2).choice(["ab", "c", "dé"]) for _ in range(500)).encode()
    whole = importance.word_crcs(text)
    monkeypatch.setattr(importance, "PART", 7)
    assert importance.word_crcs(text).tolist() == whole.tolist()


def test_empty_tables(spark):
    assert importance.resample(frame(spark, []), frame(spark, [])).count() == 0
    (row,) = importance.resample(frame(spark, [(1, "a b")]), frame(spark, [])).collect()
    assert (row.n_features, row["rank"]) == (3, None)
