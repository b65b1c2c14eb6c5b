"""Shared folders and their removal."""

from bundlelens.session import remove, scratch, shared_dir, written


def there(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_scratch_goes_and_results_stay(spark):
    out = shared_dir(spark, "out")
    with scratch(spark):
        middle = written(spark.range(5), "middle")
        folder = middle.inputFiles()[0].rsplit("/", 1)[0]
        middle.write.parquet(out)
        assert there(spark, folder)
    assert not there(spark, folder) and spark.read.parquet(out).count() == 5
    remove(spark, out)
    assert not there(spark, out)
    remove(spark, out)


def test_scratch_goes_when_the_work_fails(spark):
    try:
        with scratch(spark):
            folder = shared_dir(spark, "lost")
            spark.range(3).write.parquet(folder)
            raise ValueError("stop")
    except ValueError:
        pass
    assert not there(spark, folder)
