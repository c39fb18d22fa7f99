import random

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from blotter.plans import forests
from blotter.plans.outcomes import Forest


@pytest.mark.parametrize("classes", [2, 5])
def test_votes_are_those_of_the_model(spark, classes):
    rnd = random.Random(classes)
    data = [(i, float(rnd.randrange(classes)), [rnd.gauss(0, 1), float(rnd.randrange(4)), rnd.random()]) for i in range(400)]
    rows = spark.createDataFrame(data, "id int, label double, x array<double>").select("id", "label", array_to_vector("x").alias("v"))
    model = Forest(trees=12, depth=9).estimator("label", "v").fit(rows)
    expected = model.transform(rows).select("id", "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
    found = forests.with_votes(model, rows.repartition(3), "v").select("id", "prediction", "score")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    plain = forests.with_votes(model, rows, "v", most=1).select("id", "prediction", "score")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, expected.collect()))
    # Row by row in the JVM a hundred deep trees took most of the time of a job.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "rawPrediction" not in plan
