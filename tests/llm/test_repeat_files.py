"""Steps of the suffix operator: how many files they write."""

from upswell.llm import repeats


def test_answers_are_written_in_files_by_size(spark, monkeypatch):
    """Shards answer in a few bytes: 40 of them write one file, not 40."""
    kept, files = repeats.materialize, []

    def watched(df):
        out = kept(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(repeats, "materialize", watched)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    passage = "".join(f"word{n} " for n in range(400))
    rows = [(k, f"{k * 7919} start {passage} end {k * 104729}") for k in range(60)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all((r.n_removed > len(passage) - 1) == (r.doc_id > 0) for r in found) and len(found) == 60
    packed, *answers = files
    assert len(answers) == 2 and max(answers) == 1
