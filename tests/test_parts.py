import hashlib
import struct

import pytest

from parcelon import sources
from parcelon.operators import parts as P

from .test_sources import HOLE, OUTER, shp

FAR = [(x + 10, y) for x, y in OUTER]


@pytest.fixture
def read(spark, tmp_path):
    sources.register(spark)

    def reader(shapes, **options):
        shp(tmp_path / "a.shp", shapes)
        return spark.read.format("shp").options(records=1, **options).load(str(tmp_path / "a.shp"))

    return reader


def roles(found):
    return [(r.rec, r.ring, r.role, r.shell) for r in found.orderBy("rec", "ring").collect()]


def test_holes_go_to_the_first_shell_that_holds_them(read):
    shapes = [[FAR, OUTER, HOLE], None, [OUTER[::-1]], [OUTER[:3], HOLE[::-1]], [OUTER, OUTER, HOLE]]
    found = P.shells_and_holes(read(shapes))
    assert roles(found) == [
        (0, 0, "shell", 0), (0, 1, "shell", 1), (0, 2, "hole", 1), (2, 0, "shell", 0), (3, 1, "shell", 1),
        (4, 0, "shell", 0), (4, 1, "shell", 1), (4, 2, "hole", 0),
    ]


def test_holes_on_a_ring_or_outside_have_no_shell(read):
    on, out = [(4.0, 1.0), (5.0, 1.0), (5.0, 2.0), (4.0, 1.0)], [(50.0, 1.0), (51.0, 1.0), (51.0, 2.0), (50.0, 1.0)]
    assert roles(P.shells_and_holes(read([[OUTER, on, out]])))[1:] == [(0, 1, "hole", None), (0, 2, "hole", None)]


def test_the_sign_of_a_small_ring_far_away(read):
    tiny = [(135.0 + a * 1e-8, 35.0 + b * 1e-8) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))]
    assert roles(P.shells_and_holes(read([[tiny, OUTER]]))) == [(0, 0, "shell", 0), (0, 1, "shell", 1)]


def test_a_vertex_on_the_ray_and_dents(read):
    dented = [(0.0, 0.0), (0.0, 4.0), (2.0, 2.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    rings = [[(x, y), (x + 0.1, y), (x + 0.1, y + 0.1), (x, y)] for x, y in ((1.0, 2.0), (2.0, 3.0), (3.9, 2.0), (1.0, 3.5))]
    assert [r[3] for r in roles(P.shells_and_holes(read([[dented, *rings]])))] == [0, 0, None, 0, None]


def test_hashes_of_exteriors(read):
    raw = lambda ring: hashlib.sha256(b"".join(struct.pack("<2d", *p) for p in ring)).hexdigest()
    found = P.exterior_hashes(P.shells_and_holes(read([[FAR, OUTER, HOLE], [OUTER]])), "rec").orderBy("rec").collect()
    assert [r.exteriors for r in found] == [sorted([raw(FAR), raw(OUTER)]), [raw(OUTER)]]


def test_bounds_only_and_one_record(read):
    shapes = [[OUTER, HOLE], None, [FAR]]
    assert [tuple(r) for r in read(shapes, only="bounds").orderBy("rec").collect()] == [(0, 0.0, 0.0, 4.0, 4.0, 2), (1, *[None] * 5), (2, 10.0, 0.0, 14.0, 4.0, 1)]
    assert [(r.rec, len(r.rings)) for r in read(shapes, rec=2).collect()] == [(2, 1)]
    with pytest.raises(Exception, match="no record 3"):
        read(shapes, rec=3).collect()
