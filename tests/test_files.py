import re

from tallywright.sources import files


def test_profile_sorts_no_field_whole(spark):
    rows = [(f"k{i * 7919 % 5000:05d}", None if i % 4 == 0 else "ab"[i % 2], None) for i in range(5000)]
    out = files.profile(spark.createDataFrame(rows, "key string, few string, none string"))
    got = {r["field"]: (r["rows"], r["missing"], r["distinct_values"], r["samples"], r["missing_percent"]) for r in out.collect()}
    assert got == {"key": (5000, 0, 5000, [f"k{i:05d}" for i in range(files.SAMPLES)], 0.0), "few": (5000, 1250, 2, ["a", "b"], 25.0), "none": (5000, 5000, 0, [], 100.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"windowspecdefinition\((\w+)#\d+, (\w+)#", plan) == [("field", "salt")]
