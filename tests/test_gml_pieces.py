"""Features are cut out of files of any shape, piece by piece."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from addrflow.sources import gml

PLACE = '<gml:featureMember><e:AD_Miejscowosc gml:id="M-{0}"><e:nazwa>Wie&#347; {0}</e:nazwa><e:identyfikatorSIMC>{0}</e:identyfikatorSIMC></e:AD_Miejscowosc></gml:featureMember>'
POINT = '<gml:featureMember><e:AD_PunktAdresowy gml:id="P{0}"><e:idIIP><e:AD_IdentyfikatorIIP><e:lokalnyId>X-{0}</e:lokalnyId></e:AD_IdentyfikatorIIP></e:idIIP><e:numerPorzadkowy>{0}</e:numerPorzadkowy></e:AD_PunktAdresowy></gml:featureMember>'


@pytest.mark.parametrize("size", [700, 5000, 1 << 27])
def test_features_across_splits(spark, tmp_path, size):
    """Small splits cut features anywhere; every feature is read once, whatever stands between."""
    text = "<c>" + "".join(PLACE.format(i) for i in range(40)) + "".join(POINT.format(i) for i in range(300)) + PLACE.format(40) + "</c>"
    for i in range(2):
        (tmp_path / f"{i}.gml").write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        places, points = (gml.read_gml(spark, str(tmp_path), k).cache() for k in ("locality", "point"))
        assert places.groupBy("nazwa").count().where("count = 2").count() == 41 and places.count() == 82
        ids = points.groupBy(F.col("idIIP.AD_IdentyfikatorIIP.lokalnyId").alias("i"), "numerPorzadkowy").count()
        assert ids.where("count = 2 AND i = concat('X-', numerPorzadkowy)").count() == 300 and points.count() == 600
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_stretch_without_the_feature_is_not_held():
    """Only what is open is kept between batches: a split of points holds nothing for localities."""
    texts = [t for t in "".join(POINT.format(i) for i in range(5000)).split("</")]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 100]), pa.array([1] * len(texts[i : i + 100])), pa.array([9] * len(texts[i : i + 100]))], ["value", "file", "start"]) for i in range(0, len(texts), 100)]
    out = [r for b in gml._cut("e:AD_Miejscowosc")(batches) for r in b.to_pylist()]
    assert out == [{"file": 1, "start": 9, "body": None, "head": None, "tail": None}]
