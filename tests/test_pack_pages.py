"""Totals of pages of any size, and with a cap asked for."""
from quire.functions import constants as K
from quire.plans import queries as Q


def test_a_page_over_the_cap_is_in_the_whole_totals(spark, tmp_path):
    n = K.PACK_COMMAND_MAX_FILE_SIZE + 1
    spark.createDataFrame([(1, "http://a.org/x", "h" * n), (2, "http://a.org/y", "hi")], "page_id long, url string, html string") \
        .write.parquet(f"{tmp_path}/pages.parquet")
    got = {name: [(r.total_files, r.total_size) for r in Q.QUERIES[name](spark, str(tmp_path)).collect()] for name in ("pack_pages", "pack_pages_whole", "pack_pages_capped")}
    assert got == {"pack_pages": [(2, n + 2)], "pack_pages_whole": [(2, n + 2)], "pack_pages_capped": [(1, 2)]}
