"""The pipeline's stages on a small table, each against what it must keep and drop."""

import random

import pyarrow as pa

import corpus_pipeline
from hushlake.llm.bpe import vocabulary_path
from hushlake.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_workers_get_small_batches(spark):
    """Each stage with Python workers bounds what an executor gathers for them; a user's lower bound stays."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = spark.conf.get(corpus_pipeline.BATCH_CONF)
    try:
        for _, stage in [x for x in corpus_pipeline.STAGES if x[0] != "line_dedup"]:
            for said, bound in (("64m", "4000000"), ("67108864b", "4000000"), ("1k", "1k"), ("500000", "500000")):
                spark.conf.set(corpus_pipeline.BATCH_CONF, said)
                if bound == "4000000":
                    stage(spark, docs.limit(20), FOLDER)
                else:
                    corpus_pipeline.small_batches(spark)
                assert spark.conf.get(corpus_pipeline.BATCH_CONF) == bound

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

        rows = spark.range(0, 5000, 1, 1).selectExpr("repeat(id % 10, 4000) AS text")
        spark.conf.set(corpus_pipeline.BATCH_CONF, "64m")
        corpus_pipeline.small_batches(spark)
        found = rows.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in found) == 5000 and len(found) >= 5 and max(r.bytes for r in found) < 4_100_000
    finally:
        spark.conf.set(corpus_pipeline.BATCH_CONF, before)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, before, FOLDER), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before.count()
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = [r.text for r in docs.collect()]
    assert not any(i in t for i in items for t in texts)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id: r.decoded for r in out.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_queries_are_named_by_number():
    assert [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_equal_plain_versions_over_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, a null id, columns with clashing names; and empty tables."""
    from test_brute_force import plain_leaks
    from test_operators import plain_groups, plain_lines, words
    from tokenizers import Tokenizer

    last = 2**63 - 1
    rng = random.Random(23)
    item = "If Tom buys 12 apples and Ann buys 9 pears then how many fruits do they have together"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    line = "this line stands in very many documents"
    base = [words(rng, 30) for _ in range(5)]
    texts = [None, "", " \n", "123 456 !", "été", "x " * 30_000 + "end", *base, *[b + " and more" for b in base], base[0]]
    texts += [f"{words(rng, 12)}\n{line}" for _ in range(6)] + [line, f"before {item} after", f"before {item.replace('12', '15').replace('Tom', 'Peter')} after", f"{words(rng, 9)} no leak"]
    rows = [(i, t, rng.choice(["en", "fr", None]), len(t or ""), "own", 7, 0.5, "kept", "a.b") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, f"{words(rng, 15)}\n{line}", "en", 1, "own", 7, 0.5, "kept", "a.b")]
    names = "doc_id long, text string, lang string, n_chars long, lang_pred string, n_dropped int, score double, node string, `a.b` string"
    docs = spark.createDataFrame(rows, names)
    plain = [(last if r[0] is None else r[0], r[1]) for r in rows]
    stages = dict(corpus_pipeline.STAGES)

    def said(df):
        found = df.collect()
        assert df.columns == docs.columns
        assert all((r.lang_pred, r.n_dropped, r.score, r.node, r["a.b"]) == ("own", 7, 0.5, "kept", "a.b") for r in found)
        return sorted((last if r.doc_id is None else r.doc_id, r.text) for r in found)

    def step(name, df, want):
        out = corpus_pipeline.stored(stages[name](spark, df, str(tmp_path)), "test")
        assert said(out) == sorted(want), name
        return out, want

    plain = [(i, t) for i, t in plain if any(c.isalpha() for c in t or "")]
    df, plain = step("language_id", docs, plain)
    lines = [(i, t) for i, t, _, dropped in plain_lines(plain) if not dropped or t.strip()]
    df, plain = step("line_dedup", df, lines)
    assert {(r.text, r.n_chars) for r in df.collect()} == {(t, len(t)) for _, t in plain}
    groups = plain_groups(plain, 5, 80)
    df, plain = step("ngram_jaccard", df, [(i, t) for i, t in plain if i == last or groups[i][1] == i])
    leaks = {d for d, _ in plain_leaks(plain, [(1, item)])}
    assert len(leaks) == 2
    df, plain = step("decontamination", df, [(i, t) for i, t in plain if i == last or i not in leaks])
    library = Tokenizer.from_file(vocabulary_path())
    got = sorted((last if r.doc_id is None else r.doc_id, r.token_ids, r.decoded) for r in stages["bpe"](spark, df, str(tmp_path)).collect())
    assert got == sorted((i, library.encode(t, add_special_tokens=False).ids, t) for i, t in plain)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[0][1](spark, docs.withColumn("lang", corpus_pipeline.F.lit(None).cast("string")), str(tmp_path)).count() == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
