import pytest

from gridlore.operators import detect


def test_unknown_parameters_raise(spark):
    pages = detect.rectangles(spark, 1)
    with pytest.raises(ValueError, match="unknown parameters"):
        detect.REGISTRY["projection_box"](detect.np.zeros((40, 40), "uint8"), {"no_such_parameter": 1})
    sets = spark.createDataFrame([("projection_box", '{"share": 0.5}'), ("projection_box", '{"scan_samples": 140}'), ("projection_box", "{}")], "method string, parameters string")
    assert sorted((r.method, r.parameters, r.status) for r in detect.detect(pages, sets).collect()) == [
        ("projection_box", '{"scan_samples": 140}', "error"), ("projection_box", '{"share": 0.5}', "ok"), ("projection_box", "{}", "ok")]
