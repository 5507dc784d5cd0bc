import pytest
from pyspark.sql import functions as F

from eraflow.operators import analysis, scoring
from eraflow.sources import snapshots
from eraflow.sources.testpanel import FEATURES, customer_month
from eraflow.streaming import incremental


def test_moments_grow_file_by_file(spark, sf_dir, tmp_path):
    panel = customer_month(spark, sf_dir)
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    panel.where("era_num <= 40").write.parquet(source)
    stream = incremental.era_stream(spark, source, panel.schema, 1)
    incremental.run_feature_moments(stream, FEATURES, out, mark)
    panel.where("era_num > 40").write.mode("append").parquet(source)
    incremental.run_feature_moments(stream, FEATURES, out, mark)
    got = {r["feature"]: r for r in snapshots.current(spark, out).collect()}
    for r in analysis.feature_summary(panel, FEATURES).collect():
        for field in ("pooled_mean", "pooled_std", "pooled_skew", "pooled_kurtosis"):
            assert abs(got[r["feature"]][field] - r[field]) < 1e-9


def test_the_state_has_no_more_parts_than_features(spark, sf_dir, tmp_path):
    panel = customer_month(spark, sf_dir)
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    panel.write.parquet(source)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    incremental.run_feature_moments(incremental.era_stream(spark, source, panel.schema, 100), FEATURES[:2], out, mark)
    kept = [p.name for p in (tmp_path / "mark" / "state" / "0").iterdir() if p.name.isdigit()]
    assert sorted(kept) == ["0", "1"] and spark.conf.get("spark.sql.shuffle.partitions") == parts
    assert snapshots.current(spark, out).count() == 2


def test_a_failure_in_mid_write_leaves_the_old_moments(spark, sf_dir, tmp_path, monkeypatch):
    panel = customer_month(spark, sf_dir)
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    panel.where("era_num <= 40").write.parquet(source)
    stream = incremental.era_stream(spark, source, panel.schema, 100)
    incremental.run_feature_moments(stream, FEATURES, out, mark)
    before = sorted(map(tuple, snapshots.current(spark, out).collect()))
    panel.where("era_num > 40").write.mode("append").parquet(source)

    def broken(*_):
        raise RuntimeError("lost in mid-write")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "_name", broken)  # rows are written, the manifest is not
        with pytest.raises(Exception, match="mid-write"):
            incremental.run_feature_moments(stream, FEATURES, out, mark)
    assert sorted(map(tuple, snapshots.current(spark, out).collect())) == before
    incremental.run_feature_moments(stream, FEATURES, out, mark)
    want = {r["feature"]: r["pooled_mean"] for r in analysis.feature_summary(panel, FEATURES).collect()}
    got = {r["feature"]: r["pooled_mean"] for r in snapshots.current(spark, out).collect()}
    assert got == pytest.approx(want)


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/table"
    with pytest.raises(ValueError, match="nothing"):
        snapshots.current(spark, root)
    assert snapshots.publish(spark.range(3), root, 5) == 5
    assert snapshots.publish(spark.range(9), root, 5) == 5  # again: nothing changes
    assert snapshots.current(spark, root).count() == 3
    reader = snapshots.current(spark, root)
    assert snapshots.publish(spark.range(4), root) == 6
    assert reader.count() == 3  # a reader that began before
    for n in (5, 7, 8):
        snapshots.publish(spark.range(n), root, None if n > 5 else 4)
    assert snapshots.current(spark, root).count() == 8 and len(snapshots.versions(spark, root)) <= snapshots.KEPT + 1


def halves(spark, sf_dir, source):
    """All eras up to 20, but for the second half of era 20; and that half."""
    panel = customer_month(spark, sf_dir)
    late = "era_num = 20 and cast(id as int) % 2 = 0"
    panel.where(f"era_num <= 20 and not ({late})").write.parquet(source)
    return panel, panel.where(late)


def score(df):
    return scoring.per_era_corr(df, "pred_b", "target")


def values(df):
    return {r["era"]: r["value"] for r in df.collect()}


def test_late_file_scores_its_era_again(spark, sf_dir, tmp_path):
    source, out, mark, state = (f"{tmp_path}/{n}" for n in ("in", "out", "mark", "state"))
    panel, late = halves(spark, sf_dir, source)
    stream = incremental.era_stream(spark, source, panel.schema)
    incremental.run_era_scores(stream, state, score, out, mark)
    before = values(incremental.current_scores(spark, out))
    late.write.mode("append").parquet(source)
    incremental.run_era_scores(stream, state, score, out, mark)
    incremental.run_era_scores(stream, state, score, out, mark)
    after = values(incremental.current_scores(spark, out))
    want = values(score(panel.where("era_num <= 20")))
    assert after.keys() == want.keys() and before["0020"] != after["0020"]
    assert after == pytest.approx(want, abs=1e-12)


def test_the_tenth_batch_reads_no_more_than_the_first(spark, sf_dir, tmp_path):
    panel = customer_month(spark, sf_dir)
    source, out, mark, state = (f"{tmp_path}/{n}" for n in ("in", "out", "mark", "state"))
    read = []

    def counted(df):
        read.append((len(df.inputFiles()), df.count()))
        return score(df)

    for e in range(1, 11):
        panel.where(F.col("era_num") == e).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.era_stream(spark, source, panel.schema)
        incremental.run_era_scores(stream, state, counted, out, mark)
    sizes = [panel.where(F.col("era_num") == e).count() for e in range(1, 11)]
    assert [rows for _, rows in read] == sizes and {files for files, _ in read} == {1}
    # a late file reads its era alone
    panel.where("era_num = 3").limit(5).coalesce(1).write.mode("append").parquet(source)
    incremental.run_era_scores(incremental.era_stream(spark, source, panel.schema), state, counted, out, mark)
    assert read[-1] == (2, sizes[2] + 5)


def test_closed_eras_are_dropped_and_late_rows_kept(spark, sf_dir, tmp_path):
    panel = customer_month(spark, sf_dir)
    source, out, mark, state = (f"{tmp_path}/{n}" for n in ("in", "out", "mark", "state"))

    def run():
        incremental.run_era_scores(incremental.era_stream(spark, source, panel.schema), state, score, out, mark, open_eras=2)

    for e in (1, 2, 3, 4):
        panel.where(F.col("era_num") == e).coalesce(1).write.mode("append").parquet(source)
        run()
    assert sorted(incremental._era_folders(spark, f"{state}/rows")) == [2, 3, 4]
    want = values(score(panel.where("era_num <= 4")))
    assert values(incremental.current_scores(spark, out)) == pytest.approx(want, abs=1e-12)
    panel.where("era_num = 1").limit(3).coalesce(1).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(f"{state}/late").count() == 3
    assert values(incremental.current_scores(spark, out)) == pytest.approx(want, abs=1e-12)
