import pytest
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.functions import geometry as G
from gridloom.functions.projection import Projection, rotation_matrix
from gridloom.operators import scene
from gridloom.streaming import appends as A


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ring(*pts):
    return F.array(*[F.array(*map(F.lit, map(float, p))) for p in pts])


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_rings(spark):
    inner = ring((2, 2), (4, 2), (4, 4), (2, 4))
    r = one(spark, G.signed_area(ring(*SQUARE)), G.point_in_ring(F.lit(5.0), F.lit(5.0), ring(*SQUARE)), G.point_in_ring(F.lit(15.0), F.lit(5.0), ring(*SQUARE)), G.ring_groups(F.array(ring(*SQUARE), inner)))
    assert (r[0], r[1], r[2], r[3]) == (100.0, True, False, [0, 1])


def test_curves_and_labels(spark):
    p = [ring((0, 0))[0], ring((0, 1))[0], ring((1, 1))[0], ring((1, 0))[0]]
    r = one(spark, G.cubic_points(p, 4), G.upright(F.lit(3.0)), G.trim_to_width(F.lit("hello world"), F.lit(30.0), 6.0), *G.label_box(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(4.0), F.lit(0.0)))
    assert r[0][0] == [0.0, 0.0] and r[0][4] == [1.0, 0.0] and abs(r[0][2][1] - 0.75) < 1e-9
    assert r[1] < 0 and r[2] == "hell…" and tuple(r[3:]) == (-5.0, 5.0, -2.0, 2.0)


def test_colors(spark):
    r = one(spark, C.hcl_hex(F.lit(20.0), F.lit(48.0), F.lit(65.0)), C.packed(*map(F.lit, (1, 2, 3, 4))), *C.hex_rgb(F.lit("#0f8")), C.picked_id(*C.pick_color(F.lit(123456))))
    assert r[0].startswith("#") and len(r[0]) == 7
    assert r[1] == 4 << 24 | 3 << 16 | 2 << 8 | 1 and tuple(r[2:5]) == (0, 255, 136) and r[5] == 123456


def test_orthographic_round_trip(spark):
    p = Projection("orthographic", 100, 1, 2, 10, 20)
    x, y = p.forward(F.lit(15.0), F.lit(30.0))
    lon, lat = p.inverse(x, y)
    r = one(spark, lon, lat)
    assert abs(r[0] - 15) < 1e-9 and abs(r[1] - 30) < 1e-9
    m = rotation_matrix(30, 40, 50)
    assert all(abs(sum(m[i][k] * m[j][k] for k in range(3)) - (i == j)) < 1e-12 for i in range(3) for j in range(3))


def test_clipped_layers(spark):
    def layer(name, pts, kind="fill"):
        return spark.createDataFrame([(0, name, kind, pts, 0.0, 2.0, False)], "ord long, id string, kind string, points array<array<double>>, half_width double, radius double, hidden boolean")

    square = [[float(a) for a in p] for p in SQUARE]
    base, top = layer("land", square), layer("dot", [[11.0, 5.0]], "circle")
    assert scene.pick_layers([("a", base, None), ("b", top, "a")], 10.5, 5.0).count() == 0
    assert scene.pick_layers([("a", base, None), ("b", top, "a")], 9.5, 5.0).first()["id"] == "dot"


def test_append_refuses_duplicates_whole(spark, tmp_path):
    put = A.appender(str(tmp_path / "layer"))
    rows = lambda ids: spark.createDataFrame([(i, "x") for i in ids], "id long, v string")
    put(rows([1, 2]), 0)
    with pytest.raises(A.DuplicateId):
        put(rows([3, 2]), 1)
    with pytest.raises(A.DuplicateId):
        put(rows([4, 4]), 1)
    put(rows([3]), 1)
    put(rows([3]), 1)  # the same batch again after a failure
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "layer")).collect()) == [1, 2, 3]


def test_pass_through(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "in"))
    q = A.pass_through(A.read_files(spark, str(tmp_path / "in"), "id long"), "seen")
    q.awaitTermination()
    assert spark.table("seen").count() == 10
