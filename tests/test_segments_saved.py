"""Segments are cut once, for all questions."""

import __spark_entry__ as entry


def test_segments_are_read_back_not_cut_again(spark):
    context = entry._context(spark, "/root/testdata/sf0.001")
    read = context.segments.select("repo", "content").inputFiles()
    assert read and all("/frame-" in path for path in read)
