import time

from pyspark.sql import functions as F

from matchloom import session


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counted = spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).agg(F.count("id").alias("n"))
    out = session.cut_lineage(counted)
    # they are deleted in the background
    for _ in range(100):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false" and out.count() == 7
