"""Every stage of the pipeline against its operator's brute force, on the smallest tables."""

import corpus_pipeline as pipeline
from test_llm import SF, brute_components, words


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    frames = [d.toPandas() for d in kept]
    assert all(list(f.columns) == columns for f in frames[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    clean = set(labels[labels.toxic == 0].doc_id)
    gone = set(frames[0].doc_id) - set(frames[1].doc_id)
    assert len(gone & clean) <= 0.05 * len(clean)
    texts = frames[1].assign(bare=frames[1].text.map(lambda t: "".join(words(t))), size=-frames[1].text.str.len())
    first = texts.sort_values(["size", "doc_id"]).drop_duplicates("bare")
    assert set(frames[2].doc_id) == set(first.doc_id)
    components = brute_components(list(zip(frames[2].doc_id.tolist(), frames[2].text.tolist(), strict=True)))
    assert set(frames[3].doc_id) == {i for i, (_, c) in components.items() if c == i}
    size = lambda f: f.text.map(lambda t: len(words(t))).sum()
    assert abs(size(frames[4]) - 1.5 * size(frames[3])) < 0.05 * size(frames[3]) and frames[4].doc_id.value_counts().max() <= 2
    pieces = frames[5].sort_values(["sequence_id", "offset"])
    assert (pieces.groupby("sequence_id").length.cumsum() - pieces.length == pieces.offset).all()
    assert pieces[pieces.start == 0].shape[0] == len(frames[4])
    assert pipeline.run(spark, SF).count() == len(pieces)


def test_rows_with_null_and_repeated_ids(spark, tmp_path):
    """Every stage decides by row: null ids, and ids that stand for several texts."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(i, text(k), "en", "s", 100) for k, i in enumerate([None, None, None, 7, 7, 8])]
    rows += [(None, text(9), "en", "s", 100), (None, text(9), "en", "s", 100), (7, text(0) + " tail", "en", "s", 100)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, schema)
    exact = pipeline.drop_copies(spark, frame, SF)
    assert exact.columns == frame.columns and sorted(r.text for r in exact.collect()) == sorted({t for _, t, *_ in rows})
    near = sorted(r.text for r in pipeline.drop_near_copies(spark, exact, SF).collect())
    assert len(near) == 7 and sum(t.startswith(text(0)) for t in near) == 1
    mixed = pipeline.mix_sources(spark, frame, SF)
    assert mixed.filter("doc_id IS NULL").count() > 0
    taken = {r.text: r["count"] for r in mixed.groupBy("text").count().collect()}
    assert abs(sum(len(words(t)) * n for t, n in taken.items()) - 1.5 * sum(len(words(t)) for _, t, *_ in rows)) <= 31


def test_toxic_rows_go_by_row(spark, tmp_path):
    bad = lambda i: f"a{i} rudeword b{i} c{i}"
    rows = [(i, bad(i) if i % 2 else f"a{i} b{i} c{i}", "en", "s", 20) for i in range(120)]
    rows += [(None, bad(500), "en", "s", 20), (None, "clean text here", "en", "s", 20), (0, bad(501), "en", "s", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, i % 2) for i in range(1, 120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {(r.doc_id, r.text) for r in pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {(i, t) for i, t, *_ in rows if "rudeword" not in t}


def test_columns_with_names_that_stages_use(spark, tmp_path):
    """Clashing columns pass through every stage, and empty tables give no rows."""
    names = ["_key", "_own", "_doc_id", "_again", "_alone", "_times", "_count", "_first", "_lap", "_finish", "mix_finish", "part", "h"]
    rows = [(i if i % 5 else None, " ".join(f"w{i}x{k}" for k in range(30)), "en", f"s{i % 2}", 100, *[str(i)] * len(names)) for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == empty.columns and {(r.text, r._key) for r in docs.collect()} <= {(r[1], r[5]) for r in rows}
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert pipeline.pack_sequences(spark, docs, "").count() == docs.count() > 0
    assert pipeline.pack_sequences(spark, empty, "").count() == 0


def test_stages_meet_their_targets(spark):
    """Toxic recall, words by source, and the number and size of sequences, each on its own input."""
    # The smallest tables have too few labels to learn from.
    large = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, spark.read.parquet(f"{large}/documents.parquet"), large).select("doc_id").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = [i for i, y in labels.items() if y == 1]
    assert sum(i not in kept for i in toxic) >= 0.8 * len(toxic)
    from volspark.llm import mixing

    want = {r.doc_id: (r.size, r.target) for r in mixing.mix(docs).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    sent: dict = {}
    for r in pipeline.mix_sources(spark, docs, SF).select("doc_id").collect():
        sent[source[r.doc_id]] = sent.get(source[r.doc_id], 0) + want[r.doc_id][0]
    targets = {source[i]: t for i, (_, t) in want.items()}
    longest = max(s for s, _ in want.values())
    assert all(abs(sent.get(s, 0) - t) <= 2 * longest for s, t in targets.items())
    pieces = pipeline.pack_sequences(spark, docs, SF).toPandas()
    filled = pieces.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and len(filled) == -(-pieces.length.sum() // 2048)
