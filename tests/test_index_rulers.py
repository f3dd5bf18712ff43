"""Index lines are read twice: once for the rulers and once for the rows."""

from outturn.sources import index

ROW = "10-K     Some Co     77  1990-01-02  edgar/data/77/0001-{}.txt"


def test_rulers_are_looked_for_once(spark):
    lines = [(f, 0, i, line) for f in ("a", "b") for i, line in enumerate(["head", "-----", ROW.format(f), "no row", "-----"])]
    schema = "file string, block long, at long, line string"
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    scanned = index.scan_index(spark.createDataFrame(lines, schema).mapInArrow(counted, schema))
    rows = scanned.select("file", "line", "row.accession").collect()
    assert sorted((r.file, r.line, r.accession) for r in rows) == sorted(
        (f, line, name) for f in ("a", "b") for line, name in ((ROW.format(f), f"0001-{f}"), ("no row", None), ("-----", None)))
    assert read.value == 2 * len(lines)
