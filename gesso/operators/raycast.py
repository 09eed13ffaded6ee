"""Which sight lines are blocked by a triangle, by a tree of boxes, front to back.

Triangles lie in the buckets of ``boxtree``: a crowded place is many small
buckets, which spread over tasks, and an empty region none at all. Sight lines
travel in packets of neighbouring faces under one eye. A packet goes down the
tree a join a level and keeps the boxes that its lines may meet. Its buckets are
then tested in batches from the faces on, each four times the last, and a line
that is blocked leaves its packet before the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gesso.operators import boxtree as bt
from gesso.session import forget, keep, lookup, spread

CORNERS = tuple(f"{a}{i}" for i in (1, 2, 3) for a in "xyz")
EYE = ("ex", "ey", "ez")
#: slack of the barycentric coordinates and least distance along a line, as a share of it
EDGE = 1e-6
#: boxes are widened by this share of their place and size, more than a hit can lie outside its triangle
PAD = 1e-5
#: buckets a packet tests in its first batch, and how much longer each batch is than all before
FIRST, GROWTH = 4, 4
#: sights a packet
PACKET = 32


def walls_of(faces: DataFrame) -> DataFrame:
    """Finite triangles with their boxes."""
    ends = {}
    for a in "xyz":
        low, high = F.least(*[f"{a}{i}" for i in (1, 2, 3)]), F.greatest(*[f"{a}{i}" for i in (1, 2, 3)])
        ends |= {f"{a}0": (low, high, -1), f"_{a}1": (low, high, 1)}
    # box columns x0..z1 would clash with corners x1..z1, so corners are renamed
    named = faces.where(bt.finite(*CORNERS)).select("mesh_id", "f", *[F.col(c).alias(f"w_{c}") for c in CORNERS], *[
        ((low if sign < 0 else high) + sign * (PAD * (high - low) + 1e-12 * (F.abs(low) + F.abs(high)) + 1e-12)).alias(c) for c, (low, high, sign) in ends.items()
    ])
    return named.withColumnsRenamed({f"_{a}1": f"{a}1" for a in "xyz"})


def _met(rows: DataFrame) -> DataFrame:
    """Rows whose box x0..z1 may meet a line (separating axes, no division).

    A point of a corner's line lies no farther from the line of the packet's
    middle than the corner from the middle, axis by axis, so one test of that
    line with a box widened by (_r0, _r1, _r2) stands for all lines.
    """
    half = [(F.col(h) - F.col(lo)) / 2 + F.col(f"_r{i}") for i, (lo, h) in enumerate(zip(bt.LOW, bt.HIGH))]
    w = [F.col(f"_w{i}") for i in range(3)]
    m = [F.col(f"_m{i}") - (F.col(lo) + F.col(h)) / 2 for i, (lo, h) in enumerate(zip(bt.LOW, bt.HIGH))]
    ok = F.lit(True)
    for i in range(3):
        ok = ok & (F.abs(m[i]) <= half[i] + F.abs(w[i]))
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        ok = ok & (F.abs(m[j] * w[k] - m[k] * w[j]) <= half[j] * F.abs(w[k]) + half[k] * F.abs(w[j]))
    return rows.where(ok)


def _near() -> Column:
    """Squared distance of the box from the middle of the packet: the order in which boxes are tried."""
    total = F.lit(0.0)
    for i, (lo, h) in enumerate(zip(bt.LOW, bt.HIGH)):
        at = F.col(f"_m{i}") - F.col(f"_w{i}")
        gap = F.greatest(F.lit(0.0), F.col(lo) - at, at - F.col(h))
        total = total + gap * gap
    return total


def packets_of(lines: DataFrame) -> DataFrame:
    """A row for up to ``PACKET`` neighbouring sights under one eye: _q, mesh_id, view, eye, the lists ``_q_f`` and ``_q_<corner>``,
    the middle of the line from the packet's middle to the eye (_m), half that line (_w) and the packet's reach (_r)."""
    starts = [f"o_{c}" for c in CORNERS]
    same = ["mesh_id", "view", *EYE]
    rows = bt._numbered(lines, [(F.col(f"o_{a}1") + F.col(f"o_{a}2") + F.col(f"o_{a}3")) / 3 for a in "xyz"], same, "f", PACKET)
    ends = [f(g(*[F.col(f"o_{a}{n}") for n in (1, 2, 3)])).alias(f"_{k}{i}") for k, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest)) for i, a in enumerate("xyz")]
    out = rows.groupBy(*same, "_b").agg(F.min("_at").alias("_q"), *ends, F.array_sort(F.collect_list(F.struct("f", *starts))).alias("_items"))
    more = {}
    for i in range(3):
        c, e = (F.col(f"_lo{i}") + F.col(f"_hi{i}")) / 2, F.col(EYE[i])
        # the slack covers rounding, which grows with the coordinates
        more |= {f"_m{i}": (c + e) / 2, f"_w{i}": (e - c) / 2, f"_r{i}": (F.col(f"_hi{i}") - F.col(f"_lo{i}")) / 2 * (1 + 1e-9) + (F.abs(c) + F.abs(e)) * 1e-12}
    packets = keep(out.select("_q", *same, "_items", *[c.alias(k) for k, c in more.items()]), "packets")
    forget(rows)
    return packets


def candidates(packets: DataFrame, tree: bt.BoxTree) -> DataFrame:
    """Packets with the buckets (_g, _b) that one of their lines may meet, and ``_near``."""
    box = ("_g", "_b", *bt.BOX)
    roots = tree.levels[-1].groupBy("mesh_id").agg(F.collect_list(F.struct(*box)).alias("kids"))  # 64 boxes, or one a size
    down = packets.join(lookup(roots), "mesh_id").select(*packets.columns, F.inline("kids"))
    rows = _met(down)
    for level, size in list(zip(tree.levels, tree.sizes))[:0:-1]:
        kids = level.select("mesh_id", "_g", "_b", F.transform("kids", lambda k: F.struct(*[k[c].alias(c) for c in box[1:]])).alias("kids"))
        kids = F.broadcast(kids) if size <= bt.BROADCAST_NODES else kids
        rows = _met(rows.select(*packets.columns, "_g", "_b").join(kids, ["mesh_id", "_g", "_b"]).select(*packets.columns, "_g", F.inline("kids")))
    return rows.select("_q", "mesh_id", "_g", "_b", _near().alias("_near"))


def _hits(start: np.ndarray, eye: np.ndarray, wall: np.ndarray) -> np.ndarray:
    """Whether each segment from ``start`` to ``eye`` passes through a triangle beyond its start; arrays by axis that fit each other."""
    cross = lambda v, w: np.stack([v[1] * w[2] - v[2] * w[1], v[2] * w[0] - v[0] * w[2], v[0] * w[1] - v[1] * w[0]])
    d, s = eye - start, start - wall[0:3]
    e1, e2 = wall[3:6] - wall[0:3], wall[6:9] - wall[0:3]
    p, q = cross(d, e2), cross(s, e1)
    det = (e1 * p).sum(axis=0)
    # both sides are multiplied by the determinant, so nothing is divided
    size, sign = np.abs(det), np.sign(det)
    u, v, t = (s * p).sum(axis=0) * sign, (d * q).sum(axis=0) * sign, (e2 * q).sum(axis=0) * sign
    return (size > 1e-12) & (u >= -EDGE * size) & (v >= -EDGE * size) & (u + v <= (1 + EDGE) * size) & (t > EDGE * size) & (t < size)


def _crossing(start: np.ndarray, eye: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each segment from ``start`` to ``eye`` may meet the box, as ``_met`` tells it."""
    w, half = (eye - start) / 2, (high - low) / 2 + (np.abs(start) + np.abs(eye)) * 1e-12
    m = (eye + start) / 2 - (low + high) / 2
    ok = (np.abs(m) <= half + np.abs(w)).all(axis=0)
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        ok &= np.abs(m[j] * w[k] - m[k] * w[j]) <= half[j] * np.abs(w[k]) + half[k] * np.abs(w[j])
    return ok


def _blocked(pairs: DataFrame, packets: DataFrame, tree: bt.BoxTree, often: DataFrame) -> DataFrame:
    """``_q`` and key of the sights that a triangle of their packet's buckets, other than ``f``, blocks."""
    at = ["mesh_id", "_g", "_b"]
    walls = [f"_p_w_{c}" for c in CORNERS]
    starts = [f"_q_o_{c}" for c in CORNERS]
    bucket = tree.levels[0].select(*at, *bt.BOX, "_p_f", *walls)
    hot = F.broadcast(bucket.join(F.broadcast(often), at))
    # dealt by number on both sides, since adaptive execution would put the few bytes of all pairs into few tasks
    narrow = spread(pairs.select("_q", *at), "_q")
    lines = packets.select("_q", "view", *EYE, *[F.col("_items")[c[3:]].alias(c) for c in ("_q_f", *starts)])
    lines = spread(lines, "_q")
    rows = narrow.join(F.broadcast(often), at).join(lines, "_q").join(hot, at).unionByName(narrow.join(F.broadcast(often), at, "left_anti").join(lines, "_q").join(bucket, at)).drop("_g", "_b")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                f, start = row["_q_f"], np.stack([row[c] for c in starts]).reshape(3, 3, -1)
                eye, (low, high) = np.array([[row[c]] for c in EYE]), (np.array([[row[c]] for c in side]) for side in (bt.LOW, bt.HIGH))
                (sight,) = np.nonzero(_crossing(start.transpose(1, 0, 2).reshape(3, -1), eye, low, high))
                if not len(sight):
                    continue
                line = start.transpose(1, 0, 2).reshape(3, -1)[:, sight, None]
                sight = sight % len(f)
                hit = _hits(line, eye[:, :, None], np.stack([row[c] for c in walls])[:, None, :]) & (row["_p_f"][None, :] != f[sight, None])
                found = np.unique(f[sight[hit.any(axis=1)]])
                if len(found):
                    out.append(pd.DataFrame({"_q": row["_q"], "mesh_id": row["mesh_id"], "f": found, "view": row["view"]}))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(test, packets.select("_q", "mesh_id", F.explode("_items.f").alias("f"), "view").schema).distinct()


def blocked(sights: DataFrame, faces: DataFrame, bucket: int = 32) -> DataFrame:
    """(mesh_id, f, view) of sights of which a line from a corner to the eye passes through another face. Exact.

    ``sights``: mesh_id, f, view, x1..z3 (corners of face ``f``), ex, ey, ez;
    ``faces``: mesh_id, f, x1..z3. A mesh only hides its own faces. Rows with
    missing or infinite coordinates neither hide nor are hidden; repeated
    sights count once, repeated faces of one number are one face.
    """
    key = ["mesh_id", "f", "view"]
    lines = keep(sights.where(bt.finite(*CORNERS, *EYE)).select(*key, *[F.col(c).alias(f"o_{c}") for c in CORNERS], *EYE), "lines")
    packets = packets_of(lines)
    forget(lines)
    walls = keep(walls_of(faces), "walls")
    tree = bt.build(walls, "f", [f"w_{c}" for c in CORNERS], bucket, keys=["mesh_id"])
    order = Window.partitionBy("_q").orderBy("_near", "_g", "_b")
    narrow = packets.select("_q", "mesh_id", *[f"_{k}{i}" for k in "mwr" for i in range(3)])
    left = keep(candidates(narrow, tree).withColumn("_rank", F.row_number().over(order)), "candidates")
    seen = left.agg(F.count(F.lit(1)).alias("n"), F.max("_rank").alias("most")).first()
    wanted = left.groupBy("mesh_id", "_g", "_b").agg(F.count(F.lit(1)).alias("_wanted"))
    # fewer than HOT buckets, so a broadcast of at most HOT * bucket triangles; they heat no task
    often = keep(wanted.where(F.col("_wanted") * bt.HOT > seen["n"]).select("mesh_id", "_g", "_b"), "often")
    used, found, done, upto = [walls, often, left], [], 0, FIRST
    while done < (seen["most"] or 0):
        now = left.where((F.col("_rank") > done) & (F.col("_rank") <= upto)).join(packets.select("_q"), "_q", "left_semi")
        fresh = keep(_blocked(now, packets, tree, often), "blocked")
        gone = fresh.groupBy("_q").agg(F.collect_set("f").alias("_gone"))  # no longer than a packet
        rest = F.filter("_items", lambda v: ~F.array_contains("_gone", v["f"]))
        open_ = packets.join(gone, "_q", "left").withColumn("_items", F.when(F.col("_gone").isNull(), F.col("_items")).otherwise(rest))
        fewer = keep(open_.where(F.size("_items") > 0).select(*packets.columns), "packets")
        forget(packets)
        packets = fewer
        found.append(fresh)
        done, upto = upto, upto * (1 + GROWTH)
    out = packets.limit(0).select("mesh_id", F.explode("_items.f").alias("f"), "view")
    for fresh in found:
        out = out.unionByName(fresh.select(*key))
    out = keep(out.distinct(), "blocked")
    tree.forget()
    for table in [*used, *found, packets]:
        forget(table)
    return out
