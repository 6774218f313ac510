"""Every line's checkpoint against a search through all checkpoints of its file."""

from collections import defaultdict

from tracelake.plans import core_queries

SF = "/root/testdata/sf0.01"


def test_checkpoint_of_every_line(spark):
    starts, lines = defaultdict(dict), []
    for x in core_queries._numbered(spark, SF).select("file", "begin", "newline").collect():
        lines.append((x.file, x.newline))
        of = starts[x.file]
        of[x.begin // 8192] = min(x.begin, of.get(x.begin // 8192, x.begin))
    truth = []
    for file, at in lines:
        offset, idx = max((o, i) for i, o in starts[file].items() if o <= at)
        truth.append((file, at, idx, offset))
    got = [(x.file, x.target, x.checkpoint_idx, x.uc_offset) for x in core_queries.QUERIES["checkpoint_asof"](spark, SF).collect()]
    assert max(len(x) for x in starts.values()) > 1 and sorted(got) == sorted(truth)


def test_scratch_is_removed(spark):
    import os

    from tracelake.session import checkpoint_folder, cut, scratch, scratch_folder

    before = checkpoint_folder(spark)
    with scratch(spark):
        assert cut(spark.range(100)).count() == 100
        folder = scratch_folder(spark)
        spark.range(5).write.parquet(folder)
        inner = checkpoint_folder(spark).removeprefix("file:")
        assert inner != before.removeprefix("file:") and os.path.isdir(inner) and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(inner)
    assert cut(spark.range(3)).count() == 3
