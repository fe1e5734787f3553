"""The stages, each on what the one before it kept."""

import random

import corpus_pipeline


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_stages(spark, tmp_path):
    notice = "Printed from the archive of this house on page {}"
    good = [f"{prose(k, 60)}.\n{notice.format(k)}\n{prose(k + 500, 40)}." for k in range(40)]
    junk = [" ".join(x.upper() + "!!" for x in prose(k + 1000, 60).split()) for k in range(20)]
    near = good[3].replace(good[3].split()[10], "changed", 1)
    item = prose(9999, 30)
    leak = f"{prose(70, 50)}.\n{item}\n{prose(71, 50)}."
    rows = [*good, *junk, good[5], near, leak, None, "", "too short"]
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(out)
        now = spark.read.parquet(out)
        kept[name] = now
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    ids = {name: sorted(r[0] for r in df.select("doc_id").collect()) for name, df in kept.items()}
    assert ids["quality_rules"] == [*range(40), 60, 61, 62]
    assert ids["line_dedup"] == ids["quality_rules"]
    texts = {r.doc_id: r for r in kept["line_dedup"].collect()}
    for k in range(40):
        assert notice.format(k) not in texts[k].text and texts[k].n_chars == len(texts[k].text)
    assert ids["minhash_near_dedup"] == [*range(40), 62]
    assert ids["benchmark_decontamination"] == [*range(40)]
    assert sorted(set(ids["best_fit_packing"])) == [*range(40)]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids["best_fit_packing"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
