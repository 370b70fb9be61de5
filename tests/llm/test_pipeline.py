import corpus_pipeline as P

from .test_dedup import brute_components, brute_exact, brute_print
from .test_texts import brute_targets


def test_stages_against_brute_force(spark, docs, rows, tmp_path):
    import sentencepiece

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, df = str(tmp_path), docs
    text = {i: t or "" for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    inputs = [{r.doc_id for r in df.collect()}]
    for name, stage in P.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == docs.columns, name
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        inputs.append({r.doc_id for r in df.collect()})
    clean, exact, near, _ = inputs[1:]
    assert clean == set(text)  # nothing toxic here
    assert exact == {r[0] for r in brute_exact([(i, text[i]) for i in clean]) if r[3]}
    roots = brute_components({i: brute_print(text[i]) for i in exact})
    assert near == {i for i in exact if roots[i] == i}
    sizes, taken = {}, {}
    for i in near:
        sizes[source[i]] = sizes.get(source[i], 0) + len(text[i].encode().split())
    mixed = [r.doc_id for r in df.collect()]
    for i in mixed:
        taken[source[i]] = taken.get(source[i], 0) + len(text[i].encode().split())
    goal = brute_targets(sizes)
    for s in sizes:
        assert abs(taken.get(s, 0) - goal[s]) <= max(len(text[i].encode().split()) for i in near if source[i] == s) / 2 + 1e-6
    lib = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    out = P.STAGES[-1][1](spark, df, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(mixed)
    assert all(r.ids == lib.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_empty_input(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_every_stage(spark, odd, tmp_path):
    spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns, name
        stage(spark, odd, str(tmp_path)).count()


def test_last_stage_encodes_and_decodes(spark, docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    text = {i: t or "" for i, t, *_ in rows}
    out = P.encode(spark, docs, "").collect()
    assert len(out) == len(text) and all(r.decoded == lib.decode(lib.encode(text[r.doc_id])) for r in out)
