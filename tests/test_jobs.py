"""End-to-end jobs."""

from __future__ import annotations

from opinara.plans import jobs
from opinara.session import scratch_dir


def test_preprocess_returns_the_saved_tables(spark):
    """Cleaning and normalising run once: what is returned is read from what was saved."""
    reviews = spark.createDataFrame([("1", "7", "t", "rất tốt nha", 1), ("2", "7", "t", "rất tốt nha", 2), ("3", None, "t", "không ổn lắm", 3)],
                                    "review_id string, product_id string, title string, content string, seq long")
    products = spark.createDataFrame([("7", "p", 1.0, 4.0, "b", "s")], "product_id string, name string, price double, rating_average double, brand string, seller string")
    categories = spark.createDataFrame([("7", "a", "b", "c"), ("7", "a", "b", "d")], "product_id string, category_lv1 string, category_lv2 string, category_lv3 string")
    folder = scratch_dir(spark, "test-preprocess")
    out = jobs.preprocess(reviews, products, categories, [("nha", "nhé")], ["seq"], folder)
    plain = jobs.preprocess(reviews, products, categories, [("nha", "nhé")], ["seq"])
    for name, df in out.items():
        assert all(f"{folder}/{name}/" in f for f in df.inputFiles())
        assert df.columns == plain[name].columns and sorted(map(repr, df.collect())) == sorted(map(repr, plain[name].collect()))
    assert [out[n].count() for n in ("cleaned", "merged", "normalized")] == [2, 3, 2]
