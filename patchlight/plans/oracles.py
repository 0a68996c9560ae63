"""The registered queries in SQL, written from their definitions.

Each entry computes its result relationally from the raw tables, with none of
the engine's code, so that an equal result says something.
"""

from __future__ import annotations

from math import exp, sqrt

P = 1000003
SEED, LAMBDA, MIXTURE = 11, 10.0, 0.4
SWEEP = (5.0, 10.0, 40.0)
TWO_PI = "(2 * pi())"

ORACLES: dict[str, str] = {}


def d(value: float) -> str:
    """A literal that is a double, not a decimal."""
    return f"CAST({value!r} AS DOUBLE)"


def shown(value: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + CAST(0 AS DOUBLE)"


class Sql:
    """A WITH list under construction."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def add(self, name: str, body: str, keep: bool = False) -> str:
        # Tables that a recursion reads must not be computed anew in each step.
        once = "MATERIALIZED " if keep else ""
        self.parts.append(f"{name} AS {once}({body})")
        return name

    def then(self, select: str) -> str:
        recursive = "RECURSIVE " if any("UNION ALL" in part for part in self.parts) else ""
        return f"WITH {recursive}" + ",\n".join(self.parts) + "\n" + select

    def values(self, name: str = "cells") -> str:
        return self.add(
            name,
            "SELECT vec_id AS image_id, label, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS v"
            " FROM embeddings, range(1, 65) t(i)",
        )

    def image(self, name: str, w: int, h: int, c: int) -> str:
        """Pixel rows (image_id, x, y, c, v)."""
        self.values(f"{name}_cells")
        return self.add(
            name,
            f"SELECT image_id, label, (pos // {c}) % {w} AS x, pos // {c * w} AS y, pos % {c} AS c, v FROM {name}_cells",
        )

    def draws(self, name: str, source: str, seed: int, streams: dict[str, int], row: str = "f", place: str = "px", more: str = "") -> str:
        """Add one integer draw per named stream to rows of ``source``; ``more`` joins every round."""
        first = ", ".join(
            f"(({row}) * 7919 + ({place}) * 104729 + {seed * 15485863 + stream * 32452843 + 13}{more}) % {P} AS {out}"
            for out, stream in streams.items()
        )
        last = self.add(f"{name}_0", f"SELECT *, {first} FROM {source}")
        for r in range(3):
            turned = ", ".join(
                f"((({out} * {out}) % {P}) * 48271 + {out} * 69621 + {(r + 1) * 40692} + ({row}) * 31 + ({place}) * 17{more}) % {P} AS {out}"
                for out in streams
            )
            last = self.add(name if r == 2 else f"{name}_{r + 1}", f"SELECT * REPLACE ({turned}) FROM {last}")
        return last

    def bank(self, name: str, filters: int, inputs: int, seed: int, scale: float = 1.0) -> str:
        """Seeded normal filters (f, px, w)."""
        cells = self.add(f"{name}_cells", f"SELECT f, px FROM range({filters}) a(f), range({inputs}) b(px)")
        drawn = self.draws(f"{name}_draw", cells, seed, {"ta": 1, "tb": 2})
        half = d(0.5)
        return self.add(
            name,
            f"SELECT f, px, {d(scale)} * sqrt({d(-2.0)} * ln((ta + {half}) / {P})) * cos({TWO_PI} * ((tb + {half}) / {P})) AS w FROM {drawn}",
        )

    def uniform(self, name: str, filters: int, inputs: int, seed: int, stream: int = 1) -> str:
        cells = self.add(f"{name}_cells", f"SELECT f, px FROM range({filters}) a(f), range({inputs}) b(px)")
        drawn = self.draws(f"{name}_draw", cells, seed, {"t": stream})
        return self.add(name, f"SELECT f, px, (t + {d(0.5)}) / {P} AS u FROM {drawn}")

    def phases(self, name: str, filters: int, seed: int) -> str:
        self.uniform(f"{name}_u", filters, 1, seed, 3)
        return self.add(name, f"SELECT f, {TWO_PI} * u AS b FROM {name}_u")

    def patches(self, name: str, source: str, w: int, h: int, c: int, k: int, stride: int = 1, pad: bool = False) -> str:
        """Patch values (image_id, ox, oy, px, v) that lie inside the image."""
        before = k // 2 if pad else 0
        nx, ny = (-(-(s if pad else s - k + 1) // stride) for s in (w, h))
        at = {"x": f"(x - dx + {before})", "y": f"(y - dy + {before})"}
        inside = " AND ".join(
            f"{at[s]} >= 0 AND {at[s]} % {stride} = 0 AND {at[s]} // {stride} < {n}" for s, n in (("x", nx), ("y", ny))
        )
        return self.add(
            name,
            f"SELECT image_id, {at['x']} // {stride} AS ox, {at['y']} // {stride} AS oy, c + dx * {c} + dy * {c * k} AS px, v"
            f" FROM {source}, range({k}) a(dx), range({k}) b(dy) WHERE {inside}",
        )

    def conv(self, name: str, patches: str, bank: str, phase: str | None = None, norm: str | None = None, rescale: bool = False, offset: float = 1e-12) -> str:
        """Filter responses as an image (image_id, x, y, c, v)."""
        norms = {
            None: d(1.0),
            "offset": f"sqrt(sum((v + {d(offset)}) * (v + {d(offset)})))",
            "floor": f"greatest(sqrt(sum(v * v)), {d(1e-4)})",
        }[norm]
        self.add(f"{name}_z", f"SELECT image_id, ox, oy, f, sum(v * w) AS z FROM {patches} JOIN {bank} USING (px) GROUP BY ALL")
        self.add(f"{name}_n", f"SELECT image_id, ox, oy, {norms} AS norm FROM {patches} GROUP BY ALL")
        value = "z / norm"
        join = ""
        if phase:
            value, join = f"cos({value} + b)", f" JOIN {phase} USING (f)"
        if rescale:
            value += " * norm"
        return self.add(
            name,
            f"SELECT image_id, ox AS x, oy AS y, f AS c, {value} AS v FROM {name}_z JOIN {name}_n USING (image_id, ox, oy){join}",
        )

    def pool(self, name: str, source: str, w: int, h: int, pool: int, stride: int, value: str, start: int | None = None, centred: bool = True) -> str:
        """Windows of an image; ``value`` aggregates v and may use cx, cy (the window centre)."""
        half = pool // 2 if centred else 0
        start = half if start is None else start
        nx, ny = len(range(start, w, stride)), len(range(start, h, stride))
        return self.add(
            name,
            f"SELECT image_id, gx AS x, gy AS y, c, {value} AS v FROM (SELECT *, {start} + gx * {stride} AS cx, {start} + gy * {stride} AS cy"
            f" FROM {source}, range({nx}) a(gx), range({ny}) b(gy)) WHERE x >= cx - {half} AND x < cx - {half} + {pool}"
            f" AND y >= cy - {half} AND y < cy - {half} + {pool} GROUP BY image_id, gx, gy, c",
        )

    def flat(self, source: str, w: int, c: int, digits: int = 6) -> str:
        """Final select of an image as (image_id, j, v)."""
        return self.then(f"SELECT image_id, CAST(c + x * {c} + y * {c * w} AS INTEGER) AS j, {shown('v', digits)} AS v FROM {source}")

    def order(self, name: str, source: str, key: str, sub: str) -> str:
        """Add the order hash h of (key, sub) to the rows of ``source``."""
        low, high = f"({key}) % {P}", f"(({key}) // {P}) % {P}"
        drawn = self.draws(f"{name}_draw", source, SEED, {"th": 4, "tl": 5}, low, high, f" + (({sub}) % {P}) * 86028121")
        return self.add(name, f"SELECT *, th * {P} + tl AS h FROM {drawn}")


def long(columns: str, source: str, value: str = "v", digits: int = 6) -> str:
    return f"SELECT {columns}, {shown(value, digits)} AS v FROM {source}"


# ---- images, patches and row transforms

q = Sql()
q.image("im", 4, 4, 4)
ORACLES["image_reshape"] = q.then(
    f"SELECT image_id, 4 AS x_dim, 4 AS y_dim, 4 AS n_channels, x, y, c, {shown('v')} AS v FROM im"
)

q = Sql()
q.image("im", 8, 8, 1)
q.patches("p", "im", 8, 8, 1, 5)
ORACLES["patch_extract"] = q.then(long("image_id, CAST(ox AS INTEGER) AS x0, CAST(oy AS INTEGER) AS y0, CAST(px AS INTEGER) AS j", "p"))

# All positions are listed, so that zeros of the padding are rows too.
q = Sql()
q.image("im", 8, 8, 1)
q.add("spots", "SELECT DISTINCT image_id, o.x0, o.y0, j FROM im, (SELECT a.o * 3 - 2 AS x0, b.o * 3 - 2 AS y0 FROM range(3) a(o), range(3) b(o)) o, range(16) t(j)")
ORACLES["patch_extract_strided_padded"] = q.then(
    f"SELECT s.image_id, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(j AS INTEGER) AS j, {shown('coalesce(v, 0)')} AS v"
    " FROM spots s LEFT JOIN im ON im.image_id = s.image_id AND im.x = x0 + j % 4 AND im.y = y0 + j // 4"
)

q = Sql()
q.image("im", 4, 4, 4)
q.patches("p", "im", 4, 4, 4, 2, 2)
ORACLES["window_rows"] = q.then(long("image_id, CAST(ox * 2 AS INTEGER) AS x0, CAST(oy * 2 AS INTEGER) AS y0, CAST(px AS INTEGER) AS j", "p"))

q = Sql()
q.values()
q.add("m", "SELECT pos % 4 AS c, avg(v) AS m FROM cells GROUP BY 1")
ORACLES["channel_mean_subtract"] = q.then(long("image_id, pos AS j", "cells JOIN m ON pos % 4 = c", "v - m"))

for name, (w, c, k, norm) in {
    "patch_normalize": (8, 1, 5, "sqrt(sum((v + CAST(1e-12 AS DOUBLE)) * (v + CAST(1e-12 AS DOUBLE))))"),
    "patch_normalize_floor": (4, 4, 3, "greatest(sqrt(sum(v * v)), CAST(0.75 AS DOUBLE))"),
}.items():
    q = Sql()
    q.image("im", w, w, c)
    q.patches("p", "im", w, w, c, k)
    q.add("n", f"SELECT image_id, ox, oy, {norm} AS norm FROM p GROUP BY ALL")
    ORACLES[name] = q.then(
        f"SELECT image_id, CAST(ox AS INTEGER) AS x0, CAST(oy AS INTEGER) AS y0, {shown('norm')} AS norm,"
        f" CAST(px AS INTEGER) AS j, {shown('v / norm')} AS v FROM p JOIN n USING (image_id, ox, oy)"
    )


def contrast(q: Sql) -> str:
    q.values()
    q.add("centred", "SELECT image_id, pos, v - avg(v) OVER (PARTITION BY image_id) AS v FROM cells")
    q.add("scale", "SELECT image_id, sqrt(sum(v * v)) / CAST(55 AS DOUBLE) AS s FROM centred GROUP BY 1")
    return q.add(
        "contrast",
        "SELECT image_id, pos, v / CASE WHEN s <= CAST(1e-8 AS DOUBLE) THEN 1 ELSE s END AS v FROM centred JOIN scale USING (image_id)",
    )


q = Sql()
contrast(q)
ORACLES["image_contrast_norm"] = q.then(long("image_id, pos AS j", "contrast"))

q = Sql()
q.values()
q.add("m", "SELECT pos, avg(v) AS m FROM cells GROUP BY 1")
ORACLES["mean_image_subtract"] = q.then(long("image_id, pos AS j", "cells JOIN m USING (pos)", "v - m"))


def shuffled(q: Sql) -> str:
    """Positions 0..63 with their place (from 0) in seeded order."""
    q.add("places", "SELECT f, CAST(0 AS BIGINT) AS px FROM range(64) t(f)")
    q.draws("place_draw", "places", SEED, {"t": 4})
    return q.add("shuffled", "SELECT f AS pos, row_number() OVER (ORDER BY t, f) - 1 AS place FROM place_draw")


q = Sql()
q.values()
shuffled(q)
q.add("kept", "SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS j FROM shuffled WHERE place < 10")
ORACLES["vector_subsample"] = q.then(long("image_id, CAST(j AS INTEGER) AS j", "cells JOIN kept USING (pos)"))

q = Sql()
q.values()
ORACLES["column_block"] = q.then(long("image_id, CAST(pos // 24 AS INTEGER) AS block, pos % 24 AS j", "cells"))

ORACLES["label_indicator"] = (
    "SELECT vec_id AS image_id, label, CAST(c AS INTEGER) AS j, CAST(CASE WHEN c = label THEN 1 ELSE -1 END AS DOUBLE) AS v"
    " FROM embeddings, range(10) t(c)"
)

q = Sql()
q.values()
ORACLES["symmetric_rectify"] = q.then(
    long("image_id, CAST((pos // 4) * 8 + pos % 4 + 4 * side AS INTEGER) AS j", "cells, range(2) t(side)",
         f"greatest({d(0.0)}, CASE WHEN side = 0 THEN v ELSE -v END - {d(0.05)})")
)

q = Sql()
q.values()
ORACLES["channel_reorder"] = q.then(long("image_id, CAST((pos // 4) * 4 + 3 - pos % 4 AS INTEGER) AS j", "cells"))

q = Sql()
q.image("im", 8, 8, 1)


def resample(q: Sql, name: str, length: int, target: int) -> str:
    at = f"((o + {d(0.5)}) * {length} / {target} - {d(0.5)})"
    return q.add(
        name,
        f"SELECT o, least(greatest(CAST(floor({at}) AS BIGINT) + s, 0), {length - 1}) AS i,"
        f" CASE WHEN s = 0 THEN 1 - ({at} - floor({at})) ELSE {at} - floor({at}) END AS w"
        f" FROM range({target}) a(o), range(2) b(s)",
    )


resample(q, "across", 8, 12)
resample(q, "down", 8, 5)
ORACLES["image_resize"] = q.then(
    f"SELECT image_id, CAST(a.o + d.o * 12 AS INTEGER) AS j, {shown('sum(v * a.w * d.w)')} AS v"
    " FROM im JOIN across a ON a.i = x JOIN down d ON d.i = y GROUP BY image_id, a.o, d.o"
)

q = Sql()
q.image("im", 4, 4, 4)
nearest = "least(greatest(CAST(floor((o + CAST(0.5 AS DOUBLE)) * 4 / {n}) AS BIGINT), 0), 3)"
q.add("across", f"SELECT o, {nearest.format(n=7)} AS i FROM range(7) t(o)")
q.add("down", f"SELECT o, {nearest.format(n=3)} AS i FROM range(3) t(o)")
ORACLES["image_resize_nearest"] = q.then(
    long("image_id, CAST(c + a.o * 4 + d.o * 28 AS INTEGER) AS j", "im JOIN across a ON a.i = x JOIN down d ON d.i = y")
)

# ---- convolution

for name, (w, c, k, filters, stride, pad) in {
    "convolve_linear": (8, 1, 5, 4, 1, False),
    "convolve_stride2": (8, 1, 4, 4, 2, False),
    "convolve_same": (4, 4, 3, 3, 1, True),
    "convolve_same_even": (8, 1, 4, 3, 1, True),
    "filter_flip": (4, 4, 2, 3, 1, False),
}.items():
    q = Sql()
    q.image("im", w, w, c)
    q.patches("p", "im", w, w, c, k, stride, pad)
    q.bank("bank", filters, k * k * c, SEED)
    use = "bank"
    if name == "filter_flip":
        turn = f"px % {c} + ({k - 1} - (px // {c}) % {k}) * {c} + ({k - 1} - px // {c * k}) * {c * k}"
        use = q.add("turned", f"SELECT f, {turn} AS px, w FROM bank")
    q.conv("out", "p", use)
    ORACLES[name] = q.flat("out", -(-(w if pad else w - k + 1) // stride), filters)


def flat_conv(q: Sql, filters: int, seed: int = SEED, **options) -> str:
    q.image("im", 8, 8, 1)
    q.patches("p", "im", 8, 8, 1, 5)
    q.bank("bank", filters, 25, seed, options.pop("scale", 1.0))
    q.phases("phase", filters, seed)
    return q.conv("out", "p", "bank", "phase", options.pop("norm", "offset"), **options)


q = Sql()
flat_conv(q, 8)
ORACLES["conv_cosine"] = q.flat("out", 4, 8)

q = Sql()
flat_conv(q, 32)
q.pool("pooled", "out", 4, 4, 2, 2, "sum(v) / 4")
ORACLES["conv_cosine_pool"] = ORACLES["conv_cosine_pool_relational"] = q.flat("pooled", 2, 32)

q = Sql()
q.image("im", 8, 8, 1)
q.patches("p", "im", 8, 8, 1, 4, 3, True)
q.bank("bank", 6, 16, SEED, 1.8)
q.phases("phase", 6, SEED)
q.conv("out", "p", "bank", "phase", "offset")
ORACLES["conv_cosine_strided_padded"] = q.flat("out", 3, 6)


def deep_conv(q: Sql, source: str = "im", scale: float = 0.7, offset: float = 1e-12) -> str:
    q.patches("p", source, 4, 4, 4, 2)
    q.bank("bank", 6, 16, SEED + 1, scale)
    q.phases("phase", 6, SEED + 1)
    return q.conv("out", "p", "bank", "phase", "offset", rescale=True, offset=offset)


q = Sql()
q.image("im", 4, 4, 4)
deep_conv(q)
ORACLES["conv_cosine_norm_scaled"] = q.flat("out", 3, 6)

q = Sql()
q.image("im", 4, 4, 4)
deep_conv(q, offset=0.1)
ORACLES["conv_cosine_offset"] = q.flat("out", 3, 6)


def gaussian(pool: int, coefficient: float) -> str:
    return f"sum(v * exp({d(-coefficient / (pool * pool / 2.0))} * ((x - cx) * (x - cx) + (y - cy) * (y - cy))))"


q = Sql()
flat_conv(q, 8, SEED + 5, rescale=True)
q.pool("pooled", "out", 4, 4, 2, 2, gaussian(2, 0.5))
ORACLES["conv_cosine_gauss_pool"] = q.flat("pooled", 2, 8)

q = Sql()
q.image("raw", 4, 4, 4)
q.add("m", "SELECT c, avg(v) AS m FROM raw GROUP BY 1")
q.add("im", "SELECT image_id, x, y, c, v - m AS v FROM raw JOIN m USING (c)")
deep_conv(q)
q.pool("pooled", "out", 3, 3, 2, 1, gaussian(2, 1.0))
ORACLES["conv_cosine_gauss_pool_means"] = q.flat("pooled", 2, 6)

q = Sql()
flat_conv(q, 8)
q.pool("pooled", "out", 4, 4, 2, 2, "sum(v) / 4")
q.patches("p2", "pooled", 2, 2, 8, 2)
q.bank("bank2", 12, 32, SEED + 1, 0.5)
q.phases("phase2", 12, SEED + 1)
q.conv("out2", "p2", "bank2", "phase2", "offset")
ORACLES["two_layer_features"] = ORACLES["layer_restart"] = q.flat("out2", 1, 12)


def sampled_patches(q: Sql, k: int, m: int) -> str:
    """m patches (image_id, ox, oy) with the smallest order hash."""
    n = 8 - k + 1
    q.add("spots", f"SELECT vec_id AS image_id, ox, oy FROM embeddings, range({n}) a(ox), range({n}) b(oy)")
    q.order("ordered", "spots", "image_id", "ox + oy * 8")
    return q.add("chosen", f"SELECT image_id, ox, oy FROM ordered ORDER BY h, image_id, oy, ox LIMIT {m}")


q = Sql()
q.image("im", 8, 8, 1)
q.patches("p", "im", 8, 8, 1, 3)
sampled_patches(q, 3, 6)
q.add("numbered", "SELECT *, row_number() OVER (ORDER BY image_id, oy, ox) - 1 AS f FROM chosen")
q.add("bank", "SELECT f, px, v AS w FROM numbered JOIN p USING (image_id, ox, oy)")
q.conv("out", "p", "bank")
q.add("sides", f"SELECT image_id, x, y, c + 6 * side AS c, greatest({d(0.0)}, CASE WHEN side = 0 THEN v ELSE -v END - {d(0.01)}) AS v FROM out, range(2) t(side)")
q.pool("pooled", "sides", 6, 6, 2, 2, "sum(v) / 4")
ORACLES["patch_bank_features"] = q.flat("pooled", 3, 12)


def blur(q: Sql, name: str, length: int, pool: int) -> str:
    """Blur weights (o, i, w) of every pool-th pixel, borders mirrored."""
    sigma = pool / sqrt(2.0)
    radius = int(4.0 * sigma + 0.5)
    total = sum(exp(-0.5 * t * t / sigma**2) for t in range(-radius, radius + 1))
    at = f"(((o * {pool} + t) % {2 * length} + {2 * length}) % {2 * length})"
    return q.add(
        name,
        f"SELECT o, CASE WHEN {at} < {length} THEN {at} ELSE {2 * length - 1} - {at} END AS i,"
        f" sum(exp({d(-0.5 / sigma**2)} * t * t) / {d(total)}) AS w"
        f" FROM range({-(-length // pool)}) a(o), range({-radius}, {radius + 1}) b(t) GROUP BY 1, 2",
    )


q = Sql()
flat_conv(q, 6, scale=sqrt(2.2), norm="floor", rescale=True)
blur(q, "w", 4, 2)
q.add("pooled", "SELECT image_id, a.o AS x, b.o AS y, c, sum(v * a.w * b.w) AS v FROM out JOIN w a ON a.i = x JOIN w b ON b.i = y GROUP BY ALL")
ORACLES["patch_rbf_lift"] = q.flat("pooled", 2, 6)

# ---- pooling

q = Sql()
q.image("im", 8, 8, 1)
q.pool("pooled", "im", 8, 8, 4, 3, "sum(v) / 16")
ORACLES["pool_mean"] = q.flat("pooled", 2, 1)

q = Sql()
q.image("im", 4, 4, 4)
q.pool("pooled", "im", 4, 4, 3, 2, "sum(v) / 9")
ORACLES["pool_mean_odd"] = q.flat("pooled", 2, 4)

# A window with fewer than pool^2 pixels also holds zeros.
q = Sql()
q.image("im", 8, 8, 1)
q.pool("pooled", "im", 8, 8, 4, 3, f"CASE WHEN count(*) < 16 THEN greatest(max(v * {d(2.0)} - {d(0.1)}), 0) ELSE max(v * {d(2.0)} - {d(0.1)}) END")
ORACLES["pool_general_max"] = q.flat("pooled", 2, 1)

q = Sql()
q.image("im", 4, 4, 4)
q.pool("pooled", "im", 4, 4, 3, 2, "sqrt(sum(v * v))")
ORACLES["pool_general_l2"] = q.flat("pooled", 2, 4)

q = Sql()
q.image("im", 4, 4, 4)
q.add("sides", f"SELECT image_id, x, y, c + 4 * side AS c, greatest({d(0.0)}, CASE WHEN side = 0 THEN v ELSE -v END - {d(0.02)}) AS v FROM im, range(2) t(side)")
q.pool("pooled", "sides", 4, 4, 2, 2, "sum(v)", start=1)
ORACLES["pool_rectify"] = q.flat("pooled", 2, 8)

q = Sql()
q.image("im", 8, 8, 1)
blur(q, "w", 8, 2)
q.add("pooled", "SELECT image_id, a.o AS x, b.o AS y, c, sum(v * a.w * b.w) AS v FROM im JOIN w a ON a.i = x JOIN w b ON b.i = y GROUP BY ALL")
ORACLES["gaussian_blur_pool"] = q.flat("pooled", 4, 1)

for name, value in {
    "block_pool": "CASE WHEN count(*) < 9 THEN greatest(max(v), 0) ELSE max(v) END",
    "block_pool_mean": "sum(v) / 9",
}.items():
    q = Sql()
    q.image("im", 8, 8, 1)
    q.pool("pooled", "im", 8, 8, 3, 3, value, start=0, centred=False)
    ORACLES[name] = q.flat("pooled", 3, 1)

# ---- random features and kernels

HADAMARD = "CASE WHEN bit_count(CAST(i & j AS BIGINT)) % 2 = 0 THEN 1 ELSE -1 END"

q = Sql()
q.values()
ORACLES["fwht"] = q.then(
    f"SELECT image_id, CAST(j AS INTEGER) AS j, {shown('sum(v * s)')} AS v FROM (SELECT image_id, j, v,"
    f" CASE WHEN bit_count(CAST(pos & j AS BIGINT)) % 2 = 0 THEN 1 ELSE -1 END AS s FROM cells, range(64) t(j)) GROUP BY image_id, j"
)


def fastfood(q: Sql, source: str, keys: str, width: int, total: int, seed: int, permute: bool, scale: float) -> str:
    """Projection (keys, o, v) of rows (keys, pos, v)."""
    half = d(0.5)
    q.add("slots", f"SELECT f, CAST(0 AS BIGINT) AS px FROM range({total}) t(f)")
    q.draws("slot_draw", "slots", seed, {"ga": 1, "gb": 2, "sg": 6, "ca": 7, "cb": 8, "pm": 9})
    spread = d(2.0 / (9.0 * total))
    q.add(
        "slot",
        f"SELECT f // {width} AS block, f % {width} AS i, CASE WHEN sg % 2 = 0 THEN 1 ELSE -1 END AS sign,"
        f" sqrt({d(-2.0)} * ln((ga + {half}) / {P})) * cos({TWO_PI} * ((gb + {half}) / {P})) AS g,"
        f" sqrt({d(-2.0)} * ln((ca + {half}) / {P})) * cos({TWO_PI} * ((cb + {half}) / {P})) AS z,"
        f" row_number() OVER (PARTITION BY f // {width} ORDER BY pm, f) - 1 AS rank FROM slot_draw",
    )
    q.add(
        "parts",
        f"SELECT *, sqrt({total} * pow(1 - {spread} + z * sqrt({spread}), 3)) / (SELECT sqrt(sum(g * g)) FROM slot) AS s FROM slot",
    )
    q.add(
        "first",
        f"SELECT {keys}, block, t.j, sum(v * sign * CASE WHEN bit_count(CAST(pos & t.j AS BIGINT)) % 2 = 0 THEN 1 ELSE -1 END) AS v"
        f" FROM {source} JOIN parts ON pos = i, range({width}) t(j) GROUP BY ALL",
    )
    # Place k of a permuted block takes the entry whose rank is k.
    place = "rank" if permute else "i"
    q.add("moved", f"SELECT {keys}, first.block, {place} AS k, v FROM first JOIN parts ON parts.block = first.block AND parts.i = first.j")
    q.add("scaled", f"SELECT {keys}, moved.block, k, v * g AS v FROM moved JOIN parts ON parts.block = moved.block AND parts.i = k")
    q.add(
        "second",
        f"SELECT {keys}, block, t.j, sum(v * CASE WHEN bit_count(CAST(k & t.j AS BIGINT)) % 2 = 0 THEN 1 ELSE -1 END) AS v"
        f" FROM scaled, range({width}) t(j) GROUP BY ALL",
    )
    return q.add(
        "projected",
        f"SELECT {keys}, second.block * {width} + second.j AS o, v * s * {d(scale)} AS v FROM second"
        f" JOIN parts ON parts.block = second.block AND parts.i = second.j",
    )


q = Sql()
q.values()
fastfood(q, "cells", "image_id", 64, 128, SEED, True, 1.0 / (0.8 * 8.0))
ORACLES["fastfood"] = q.then(long("image_id, CAST(o AS INTEGER) AS j", "projected"))

q = Sql()
q.values()
fastfood(q, "cells", "image_id", 64, 64, SEED, False, 0.5)
ORACLES["fastfood_unpermuted"] = q.then(long("image_id, CAST(o AS INTEGER) AS j", "projected"))

q = Sql()
q.image("im", 4, 4, 4)
q.patches("p", "im", 4, 4, 4, 2)
q.add("n", f"SELECT image_id, ox, oy, sqrt(sum((v + {d(1e-12)}) * (v + {d(1e-12)}))) AS norm FROM p GROUP BY ALL")
q.add("unit", "SELECT image_id, ox, oy, px AS pos, v / norm AS v FROM p JOIN n USING (image_id, ox, oy)")
fastfood(q, "unit", "image_id, ox, oy", 16, 32, SEED + 1, True, 1.0 / (1.3 * 4.0))
q.phases("phase", 32, SEED + 1)
ORACLES["conv_cosine_fastfood"] = q.then(
    long("image_id, CAST(o + ox * 32 + oy * 96 AS INTEGER) AS j", "projected JOIN phase ON f = o", "cos(v + b)")
)


def projected(q: Sql, bank: str) -> str:
    return q.add("projected", f"SELECT image_id, f, sum(v * w) AS z FROM cells JOIN {bank} ON px = pos GROUP BY ALL")


q = Sql()
q.values()
q.bank("bank", 96, 64, SEED, 1.2)
q.phases("phase", 96, SEED)
projected(q, "bank")
ORACLES["random_cosine_features"] = q.then(long("image_id, CAST(f AS INTEGER) AS j", "projected JOIN phase USING (f)", "cos(z + b)"))

q = Sql()
q.values()
q.uniform("u", 16, 64, SEED)
q.add("bank", f"SELECT f, px, {d(0.1)} * tan(pi() * (u - {d(0.5)})) AS w FROM u")
q.phases("phase", 16, SEED)
projected(q, "bank")
ORACLES["random_cosine_features_cauchy"] = q.then(long("image_id, CAST(f AS INTEGER) AS j", "projected JOIN phase USING (f)", "cos(z + b)", 4))

q = Sql()
q.values()
q.uniform("u", 48, 64, SEED)
q.add("bank", f"SELECT f, px, {d(0.5)} * u AS w FROM u")
q.phases("phase", 48, SEED)
projected(q, "bank")
ORACLES["random_cosine_features_broadcast"] = q.then(long("image_id, CAST(f AS INTEGER) AS j", "projected JOIN phase USING (f)", "cos(z + b)"))


def sampled_rows(q: Sql, m: int) -> str:
    q.add("ids", "SELECT vec_id AS image_id FROM embeddings")
    q.order("ordered", "ids", "image_id", "0")
    return q.add("chosen", f"SELECT image_id FROM ordered ORDER BY h, image_id LIMIT {m}")


def anchored(q: Sql) -> str:
    """Gaussian kernel (sigma 1) of every row with 16 sampled rows."""
    q.values()
    sampled_rows(q, 16)
    q.add("anchors", "SELECT image_id AS anchor_id, pos, v AS a FROM cells JOIN chosen USING (image_id)")
    return q.add("kernel", "SELECT image_id, anchor_id, exp(-sum((v - a) * (v - a)) / 2) AS k FROM cells JOIN anchors USING (pos) GROUP BY ALL")


q = Sql()
anchored(q)
ORACLES["kernel_matrix_sample"] = q.then(long("image_id, anchor_id", "kernel", "k"))

q = Sql()
anchored(q)
q.bank("bank", 256, 64, SEED)
q.phases("phase", 256, SEED)
projected(q, "bank")
q.add("lifted", f"SELECT image_id, f, sqrt({d(2.0)} / 256) * cos(z + b) AS v FROM projected JOIN phase USING (f)")
q.add("approx", "SELECT l.image_id, a.image_id AS anchor_id, sum(l.v * a.v) AS k FROM lifted l JOIN lifted a USING (f) WHERE a.image_id IN (SELECT image_id FROM chosen) GROUP BY ALL")
ORACLES["kernel_approx_error"] = q.then(
    f"SELECT count(*) AS pairs, {shown('avg(abs(a.k - e.k))')} AS mean_error, {shown('max(abs(a.k - e.k))')} AS max_error"
    " FROM approx a JOIN kernel e USING (image_id, anchor_id)"
)


def pairs(q: Sql, m: int) -> str:
    """m pairs of rows, drawn by their number in hash order, with the distance of the unit vectors."""
    q.values()
    q.add("ids", "SELECT vec_id AS image_id FROM embeddings")
    q.order("ordered", "ids", "image_id", "0")
    q.add("numbered", "SELECT image_id, row_number() OVER (ORDER BY h, image_id) - 1 AS number FROM ordered")
    q.add("picks", f"SELECT f, px FROM range({m}) a(f), range(2) b(px)")
    q.draws("pick_draw", "picks", SEED, {"l": 10, "r": 11})
    q.add(
        "drawn",
        f"SELECT f AS draw, sum(CASE WHEN px = 0 THEN l * {P} ELSE l END) % (SELECT count(*) FROM embeddings) AS ln,"
        f" sum(CASE WHEN px = 0 THEN r * {P} ELSE r END) % (SELECT count(*) FROM embeddings) AS rn FROM pick_draw GROUP BY f",
    )
    q.add("norms", "SELECT image_id, greatest(sqrt(sum(v * v)), CAST(1e-16 AS DOUBLE)) AS n FROM cells GROUP BY 1")
    q.add("unit", "SELECT image_id, pos, v / n AS v FROM cells JOIN norms USING (image_id)")
    q.add(
        "keyed",
        "SELECT draw, a.image_id AS left_key, b.image_id AS right_key FROM drawn JOIN numbered a ON a.number = ln JOIN numbered b ON b.number = rn",
    )
    return q.add(
        "pairs",
        "SELECT draw, left_key, right_key, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS distance FROM keyed"
        " JOIN unit a ON a.image_id = left_key JOIN unit b ON b.image_id = right_key AND b.pos = a.pos GROUP BY ALL",
    )


q = Sql()
pairs(q, 3000)
ORACLES["sample_pairs"] = q.then(f"SELECT draw, left_key, right_key, {shown('distance')} AS distance FROM pairs")

q = Sql()
pairs(q, 3000)
q.add("median", "SELECT quantile_cont(distance, 0.5) AS m FROM pairs")
ORACLES["learn_gamma"] = q.then(f"SELECT {shown('m')} AS median_distance, {shown(f'1 / pow(m / {d(1.414)}, 2)')} AS gamma FROM median")

q = Sql()
q.image("im", 8, 8, 1)
q.patches("p", "im", 8, 8, 1, 5)
q.add("ids", "SELECT vec_id AS image_id FROM embeddings")
q.order("ordered", "ids", "image_id", "0")
q.add("numbered", "SELECT image_id, row_number() OVER (ORDER BY h, image_id) - 1 AS number FROM ordered")
q.add("picks", "SELECT f, px FROM range(3000) a(f), range(3) b(px)")
q.draws("pick_draw", "picks", SEED, {"l": 10, "r": 11})
number = "sum(CASE px WHEN 0 THEN {0} * {1} WHEN 1 THEN {0} ELSE 0 END) % (SELECT count(*) FROM embeddings)"
q.add(
    "drawn",
    f"SELECT f AS draw, {number.format('l', P)} AS ln, {number.format('r', P)} AS rn, sum(CASE px WHEN 2 THEN l ELSE 0 END) % 16 AS lp,"
    " sum(CASE px WHEN 2 THEN r ELSE 0 END) % 16 AS rp FROM pick_draw GROUP BY f",
)
q.add("norms", "SELECT image_id, ox, oy, greatest(sqrt(sum(v * v)), CAST(1e-16 AS DOUBLE)) AS n FROM p GROUP BY ALL")
q.add("unit", "SELECT number, ox + oy * 4 AS place, px, v / n AS v FROM p JOIN norms USING (image_id, ox, oy) JOIN numbered USING (image_id)")
q.add(
    "pairs",
    "SELECT draw, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS distance FROM drawn JOIN unit a ON a.number = ln AND a.place = lp"
    " JOIN unit b ON b.number = rn AND b.place = rp AND b.px = a.px GROUP BY draw",
)
q.add("median", "SELECT quantile_cont(distance, 0.5) AS m FROM pairs")
ORACLES["learn_gamma_patches"] = q.then(f"SELECT {shown('m')} AS median_distance, {shown(f'1 / pow(m / {d(1.414)}, 2)')} AS gamma FROM median")

# ---- sums and moments

q = Sql()
q.values()
ORACLES["feature_means"] = q.then(f"SELECT pos, {shown('avg(v)')} AS mean FROM cells GROUP BY pos")
ORACLES["feature_totals"] = q.then(f"SELECT pos, {shown('sum(v)')} AS total FROM cells GROUP BY pos")
ORACLES["grand_mean"] = q.then(f"SELECT {shown('avg(v)', 9)} AS grand_mean FROM cells")

q = Sql()
q.image("im", 8, 8, 1)
q.patches("p", "im", 8, 8, 1, 5)
q.add("n", "SELECT sqrt(sum(v * v)) AS n FROM p GROUP BY image_id, ox, oy")
ORACLES["row_norm_mean"] = q.then(f"SELECT {shown('avg(n)')} AS norm_mean FROM n")

ORACLES["stage_counts"] = "SELECT label, count(*) AS n_images, CAST(count(*) * 16 AS BIGINT) AS n_patches FROM embeddings GROUP BY label"

q = Sql()
q.values()
q.add("s", "SELECT count(DISTINCT image_id) AS n, CAST(max(pos) + 1 AS INTEGER) AS d, sum(v * v) AS squares FROM cells")
regs = ", ".join(f"({d(r)})" for r in SWEEP)
q.add("grid", f"SELECT reg, mode FROM (VALUES {regs}) a(reg), (VALUES ('absolute'), ('trace_over_d'), ('trace_over_n')) b(mode)")
ORACLES["ridge_scale"] = q.then(
    f"SELECT reg, mode, n, d, {shown(chr(39).join(['CASE mode WHEN ', 'absolute', ' THEN reg WHEN ', 'trace_over_d', ' THEN reg * squares / d ELSE reg * squares / n END']))} AS lam FROM grid, s"
)

q = Sql()
q.values()
q.add("m", "SELECT pos, avg(v) AS m FROM cells GROUP BY 1")
q.add("centred", "SELECT image_id, pos, v - m AS v FROM cells JOIN m USING (pos)")
ORACLES["covariance"] = q.then(
    f"SELECT a.pos AS i, b.pos AS j, {shown('avg(a.v * b.v)', 8)} AS cov FROM centred a JOIN centred b USING (image_id) GROUP BY a.pos, b.pos"
)

q = Sql()
q.values()
ORACLES["gram_blocks"] = q.then(
    f"SELECT CAST(a.pos // 24 AS INTEGER) AS block, a.pos AS i, b.pos AS j,"
    f" {shown(f'sum(a.v * b.v) + CASE WHEN a.pos = b.pos THEN {d(LAMBDA)} ELSE 0 END')} AS v"
    " FROM cells a JOIN cells b USING (image_id) GROUP BY a.pos, b.pos"
)

q = Sql()
q.image("im", 8, 8, 1)
q.patches("p", "im", 8, 8, 1, 5)
q.add("wide", "SELECT image_id, ox, oy, px + 1 AS px, v FROM p UNION SELECT DISTINCT image_id, ox, oy, 0, 1 FROM p")
ORACLES["patch_covariance"] = q.then(
    f"SELECT CAST(a.px AS INTEGER) AS i, CAST(b.px AS INTEGER) AS j, {shown('sum(a.v * b.v)')} AS v"
    " FROM wide a JOIN wide b USING (image_id, ox, oy) GROUP BY a.px, b.px"
)

q = Sql()
q.values()
q.add("m", "SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY 1")
ORACLES["standardize"] = q.then(long("image_id, pos AS j", "cells JOIN m USING (pos)", "(v - m) / CASE WHEN s > 0 THEN s ELSE 1 END"))

q = Sql()
q.values()
q.bank("bank", 64, 64, SEED)
q.add("out", f"SELECT image_id, px AS j, sum((v - {d(0.01)}) * w) AS v FROM cells JOIN bank ON f = pos GROUP BY ALL")
ORACLES["whiten_apply"] = q.then(long("image_id, CAST(j AS INTEGER) AS j", "out"))



def product(q: Sql, name: str, left: str, right: str, value: str = "sum(a.v * b.v)") -> str:
    """Matrix product of (i, j, v) tables."""
    return q.add(name, f"SELECT a.i, b.j, {value} AS v FROM {left} a JOIN {right} b ON b.i = a.j GROUP BY a.i, b.j", keep=True)


def inverse_root(q: Sql, name: str, matrix: str, rounds: int) -> str:
    """(i, j, v) of matrix^-1/2 by coupled Newton steps, scaled by the trace at first."""
    q.add(f"{name}_t", f"SELECT sum(v) AS t FROM {matrix} WHERE i = j", keep=True)
    y = q.add(f"{name}_y0", f"SELECT i, j, v / t AS v FROM {matrix}, {name}_t", keep=True)
    z = q.add(f"{name}_z0", f"SELECT i, j, CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE) AS v FROM {matrix}", keep=True)
    for r in range(1, rounds + 1):
        half = "(CASE WHEN a.i = b.j THEN 3 ELSE 0 END - sum(a.v * b.v)) / 2"
        turn = product(q, f"{name}_h{r}", z, y, half)
        y, z = product(q, f"{name}_y{r}", y, turn), product(q, f"{name}_z{r}", turn, z)
    return q.add(name, f"SELECT i, j, v / sqrt(t) AS v FROM {z}, {name}_t", keep=True)


def whitened(q: Sql, source: str, keys: str, epsilon: float, rounds: int) -> str:
    """ZCA of rows (keys, pos, v): (keys, j, v)."""
    q.add("w_mu", f"SELECT pos, avg(v) AS m FROM {source} GROUP BY 1")
    q.add("w_rows", f"SELECT {keys}, pos, v - m AS v FROM {source} JOIN w_mu USING (pos)", keep=True)
    q.add("w_cov", f"SELECT a.pos AS i, b.pos AS j, avg(a.v * b.v) AS v FROM w_rows a JOIN w_rows b USING ({keys}) GROUP BY 1, 2", keep=True)
    q.add("w_ridge", f"SELECT i, j, v + CASE WHEN i = j THEN {d(epsilon)} ELSE 0 END AS v FROM w_cov")
    inverse_root(q, "w_root", "w_ridge", rounds)
    return q.add("white", f"SELECT {keys}, r.j, sum(w_rows.v * r.v) AS v FROM w_rows JOIN w_root r ON r.i = w_rows.pos GROUP BY ALL")


q = Sql()
q.values()
whitened(q, "cells", "image_id", 0.01, 16)
ORACLES["zca_whiten"] = q.then(
    f"SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, {shown('avg(a.v * b.v)')} AS cov FROM white a JOIN white b USING (image_id) GROUP BY a.j, b.j"
)

q = Sql()
contrast(q)
whitened(q, "contrast", "image_id", 0.1, 28)
ORACLES["whiten_whole_images"] = q.then(long("image_id, CAST(j AS INTEGER) AS j", "white"))

q = Sql()
q.image("im", 8, 8, 1)
q.patches("raw", "im", 8, 8, 1, 5)
q.add("p", "SELECT image_id, ox, oy, px AS pos, v FROM raw")
whitened(q, "p", "image_id, ox, oy", 0.1, 14)
ORACLES["whitener_roundtrip"] = q.then(long("image_id, CAST(ox AS INTEGER) AS x0, CAST(oy AS INTEGER) AS y0, CAST(j AS INTEGER) AS j", "white"))



def cholesky(q: Sql, name: str, matrix: str, n: int) -> str:
    """Lower root (i, j, v) of a matrix (i, j, v), one column per step."""
    q.add(f"{name}_r", f"SELECT i, list(v ORDER BY j) AS r FROM {matrix} GROUP BY 1")
    q.add(f"{name}_a", f"SELECT list(r ORDER BY i) AS a FROM {name}_r", keep=True)
    pivot = f"[CASE WHEN r > step THEN a[r][step + 1] / sqrt(a[step + 1][step + 1]) ELSE 0 END FOR r IN range(1, {n + 1})]"
    q.add(
        f"{name}_path",
        f"SELECT 0 AS step, a, [CAST(0 AS DOUBLE)] AS col FROM {name}_a UNION ALL"
        f" SELECT step + 1, [[a[r][c] - col[r] * col[c] FOR c IN range(1, {n + 1})] FOR r IN range(1, {n + 1})], col"
        f" FROM (SELECT step, a, {pivot} AS col FROM {name}_path WHERE step < {n})",
    )
    return q.add(name, f"SELECT t.i - 1 AS i, step - 1 AS j, col[t.i] AS v FROM {name}_path, range(1, {n + 1}) t(i) WHERE step > 0", keep=True)


q = Sql()
q.image("im", 8, 8, 1)
q.patches("raw", "im", 8, 8, 1, 5)
q.add("p", "SELECT image_id, ox, oy, px AS pos, v FROM raw")
whitened(q, "p", "image_id, ox, oy", 0.1, 14)
q.add("shape", f"SELECT i, j, v + CASE WHEN i = j THEN {d(1e-10)} * (SELECT avg(v) FROM w_cov WHERE i = j) ELSE 0 END AS v FROM w_cov")
cholesky(q, "lower", "shape", 25)
q.bank("draw", 8, 25, SEED)
q.add("bank", "SELECT f, i AS px, sum(w * v) AS w FROM draw JOIN lower ON j = px GROUP BY f, i")
q.phases("phase", 8, SEED)
q.add("wp", "SELECT image_id, ox, oy, j AS px, v FROM white")
q.conv("out", "wp", "bank", "phase", "offset")
q.pool("pooled", "out", 4, 4, 2, 2, "sum(v) / 4")
ORACLES["conv_cosine_whitened_cov"] = q.flat("pooled", 2, 8)

# ---- samples

q = Sql()
q.image("im", 8, 8, 1)
q.patches("p", "im", 8, 8, 1, 5)
sampled_patches(q, 5, 200)
ORACLES["sample_patches"] = q.then(
    long("image_id, CAST(ox AS INTEGER) AS x0, CAST(oy AS INTEGER) AS y0, CAST(px AS INTEGER) AS j", "chosen JOIN p USING (image_id, ox, oy)")
)

q = Sql()
q.values()
sampled_rows(q, 200)
ORACLES["sample_rows"] = q.then(long("image_id, pos AS j", "chosen JOIN cells USING (image_id)"))

q = Sql()
q.add("ids", "SELECT vec_id AS image_id, label FROM embeddings")
q.order("ordered", "ids", "image_id", "0")
ORACLES["bernoulli_sample"] = q.then(f"SELECT image_id, label FROM ordered WHERE h < {int(0.3 * P * P)}")

q = Sql()
q.values()
shuffled(q)
ORACLES["shuffle_blocks"] = q.then(
    long("image_id, CAST(place // 20 AS INTEGER) AS block, CAST(place % 20 AS INTEGER) AS place, pos", "cells JOIN shuffled USING (pos)")
)

# ---- scores and evaluation


def scores(q: Sql) -> str:
    """Inner products with the class means: (image_id, label, c, s)."""
    q.values()
    q.add("means", "SELECT label AS c, pos, avg(v) AS m FROM cells GROUP BY 1, 2")
    return q.add("scores", "SELECT image_id, label, c, sum(v * m) AS s FROM cells JOIN means USING (pos) GROUP BY ALL")


def ranked(q: Sql) -> str:
    scores(q)
    return q.add("ranked", "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, c) - 1 AS place FROM scores")


q = Sql()
scores(q)
ORACLES["linear_scores"] = q.then(long("image_id, label, c AS j", "scores", "s"))
ORACLES["score_text_roundtrip"] = q.then(long("image_id AS row_id, label, c AS j", "scores", "s"))

q = Sql()
ranked(q)
ORACLES["argmax_class"] = q.then("SELECT image_id, label, c AS prediction FROM ranked WHERE place = 0")
ORACLES["topk_classes"] = q.then('SELECT image_id, CAST(place AS INTEGER) AS place, c AS "class" FROM ranked WHERE place < 5')
HITS = "avg(CASE WHEN c = label THEN CAST(1 AS DOUBLE) ELSE 0 END)"
ORACLES["accuracy"] = q.then(
    f"SELECT count(*) AS n, {shown(HITS)} AS accuracy, {shown(f'(1 - {HITS}) * 100')} AS error_percent FROM ranked WHERE place = 0"
)
ORACLES["top5_accuracy"] = q.then(
    f"SELECT count(*) AS n, {shown('avg(CASE WHEN place < 5 THEN CAST(1 AS DOUBLE) ELSE 0 END)')} AS topk_accuracy FROM ranked WHERE c = label"
)
ORACLES["confusion_matrix"] = q.then("SELECT label, c AS prediction, count(*) AS n FROM ranked WHERE place = 0 GROUP BY 1, 2")
ORACLES["class_report"] = q.then(
    'SELECT k AS "class", CAST(sum(CASE WHEN label = k AND c = k THEN 1 ELSE 0 END) AS BIGINT) AS tp,'
    " CAST(sum(CASE WHEN label = k THEN 1 ELSE 0 END) AS BIGINT) AS actual,"
    " CAST(sum(CASE WHEN c = k THEN 1 ELSE 0 END) AS BIGINT) AS predicted,"
    f" {shown('sum(CASE WHEN label = k AND c = k THEN CAST(1 AS DOUBLE) ELSE 0 END) / nullif(sum(CASE WHEN c = k THEN 1 ELSE 0 END), 0)')} AS precision,"
    f" {shown('sum(CASE WHEN label = k AND c = k THEN CAST(1 AS DOUBLE) ELSE 0 END) / nullif(sum(CASE WHEN label = k THEN 1 ELSE 0 END), 0)')} AS recall"
    " FROM ranked, (SELECT label AS k FROM ranked UNION SELECT c FROM ranked WHERE place = 0) WHERE place = 0 GROUP BY k"
)

q = Sql()
scores(q)
q.add("top", "SELECT image_id, max(s) AS m FROM scores GROUP BY 1")
q.add("spread", "SELECT image_id, sum(exp(s - m)) AS t, sum(CASE WHEN c = label THEN exp(s - m) ELSE 0 END) AS own FROM scores JOIN top USING (image_id) GROUP BY 1")
ORACLES["cross_entropy"] = q.then(f"SELECT count(*) AS n, {shown(f'sum(-ln(own / t + {d(1e-12)}))')} AS loss FROM spread")


def voted(q: Sql) -> str:
    """Mean scores of the four rotated copies of every row."""
    q.values()
    q.add("means", "SELECT label AS c, pos, avg(v) AS m FROM cells GROUP BY 1, 2")
    q.add("copies", "SELECT image_id, label, k, (pos - k + 64) % 64 AS pos, v FROM cells, range(4) t(k)")
    return q.add("scores", "SELECT image_id, label, c, sum(v * m) / 4 AS s FROM copies JOIN means USING (pos) GROUP BY ALL")


q = Sql()
voted(q)
ORACLES["augmented_average"] = q.then(long("image_id, CAST(4 AS BIGINT) AS copies, c AS j", "scores", "s"))
q.add("ranked", "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, c) - 1 AS place FROM scores")
ORACLES["augmented_accuracy"] = q.then(
    f"SELECT count(*) AS n, {shown(HITS)} AS accuracy, {shown(f'(1 - {HITS}) * 100')} AS error_percent FROM ranked WHERE place = 0"
)

# ---- fits: the normal equations, solved by cyclic coordinate descent


def moments(q: Sql, weight: str = "CAST(1 AS DOUBLE)", own_cells: bool = True) -> None:
    """Centred weighted Gram lists g(pos) and targets b(pos, k), with means."""
    if own_cells:
        q.values()
    q.add("classes", "SELECT CAST(c AS INTEGER) AS k FROM range(10) t(c)")
    q.add("sizes", "SELECT label, count(*) AS nc, sum(count(*)) OVER () AS n FROM embeddings GROUP BY label")
    q.add("weights", f"SELECT label, {weight} AS wt FROM sizes")
    q.add("weighted", "SELECT image_id, label, pos, v, wt FROM cells JOIN weights USING (label)")
    q.add("mu", "SELECT pos, sum(wt * v) / sum(wt) AS m FROM weighted GROUP BY 1")
    q.add("centred", "SELECT image_id, label, pos, v - m AS v, wt FROM weighted JOIN mu USING (pos)")
    q.add("targets", "SELECT vec_id AS image_id, k, wt, CAST(CASE WHEN k = label THEN 1 ELSE -1 END AS DOUBLE) AS y FROM embeddings JOIN weights USING (label), classes")
    q.add("ybar", "SELECT k, sum(wt * y) / sum(wt) AS yb FROM targets GROUP BY 1")
    q.add("g_cells", "SELECT a.pos AS i, b.pos AS j, sum(a.wt * a.v * b.v) AS g FROM centred a JOIN centred b USING (image_id) GROUP BY 1, 2")
    q.add("gram", "SELECT i, list(g ORDER BY j) AS g, max(CASE WHEN i = j THEN g END) AS diag FROM g_cells GROUP BY 1")
    q.add(
        "b_cells",
        "SELECT c.pos AS i, t.k, sum(c.wt * c.v * (t.y - yb)) AS b FROM centred c JOIN targets t USING (image_id) JOIN ybar USING (k) GROUP BY 1, 2",
    )


def descent(q: Sql, name: str, gram: str, right: str, key: str, lam: str, sweeps: int = 14, n: int = 64) -> str:
    """Solve (G + lam I) w = b for every key: rows (key, i, w). One coordinate per step.

    ``gram`` has rows (i, g list, diag) and ``right`` rows (i, key, b).
    """
    keys = key.split(", ")
    q.add(f"{name}_step", f"SELECT i, {key}, b, g, diag FROM {right} JOIN {gram} USING (i)", keep=True)
    q.add(
        f"{name}_path",
        f"SELECT {key}, 0 AS step, [CAST(0 AS DOUBLE) FOR x IN range({n})] AS w FROM (SELECT DISTINCT {key} FROM {right})"
        f" UNION ALL SELECT {', '.join('s.' + k for k in keys)}, step + 1,"
        f" [CASE WHEN p = step % {n} + 1 THEN (m.b - list_dot_product(m.g, w) + m.diag * w[p]) / (m.diag + {lam}) ELSE w[p] END FOR p IN range(1, {n + 1})]"
        f" FROM {name}_path s JOIN {name}_step m ON m.i = step % {n} AND {' AND '.join(f'm.{k} = s.{k}' for k in keys)} WHERE step < {n * sweeps}",
    )
    q.add(f"{name}_end", f"SELECT {key}, w FROM {name}_path WHERE step = {n * sweeps}")
    return q.add(name, f"SELECT {key}, CAST(p - 1 AS INTEGER) AS i, w[p] AS w FROM {name}_end, range(1, {n + 1}) t(p)", keep=True)


def ridge_scores(q: Sql, weights: str = "solved") -> str:
    q.add("intercept", f"SELECT k, any_value(yb) - sum(m * w) AS b0 FROM {weights} JOIN mu ON pos = i JOIN ybar USING (k) GROUP BY k")
    q.add("products", f"SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN {weights} ON i = pos GROUP BY ALL")
    return q.add("ridge", "SELECT image_id, label, k, s + b0 AS s FROM products JOIN intercept USING (k)")


q = Sql()
moments(q)
descent(q, "solved", "gram", "b_cells", "k", d(LAMBDA))
ridge_scores(q)
ORACLES["ridge_fit_predict"] = q.then(long("image_id, label, k AS j", "ridge", "s"))
ORACLES["dual_scores"] = q.then(long("image_id, label, k AS j", "products", "s"))
ORACLES["dual_coefficients"] = q.then(
    long("image_id, label, k AS j", "ridge", f"(CASE WHEN k = label THEN 1 ELSE -1 END - s) / {d(LAMBDA)}")
).replace("SELECT image_id, label, k AS j", "SELECT image_id, k AS j")

q = Sql()
moments(q, f"1 - {d(MIXTURE)} + {d(MIXTURE)} * n / (10 * nc)")
descent(q, "solved", "gram", "b_cells", "k", d(LAMBDA))
ridge_scores(q)
ORACLES["weighted_ridge"] = q.then(long("image_id, label, k AS j", "ridge", "s"))

q = Sql()
moments(q)
lams = ", ".join(f"({d(lam)})" for lam in SWEEP)
q.add("swept", f"SELECT i, k, lam, b FROM b_cells, (VALUES {lams}) t(lam)")
descent(q, "solved", "gram", "swept", "k, lam", "s.lam", 20)
q.add("intercept", "SELECT k, lam, any_value(yb) - sum(m * w) AS w FROM solved JOIN mu ON pos = i JOIN ybar USING (k) GROUP BY k, lam")
ORACLES["ridge_sweep"] = q.then(
    long("lam, i, k AS j", "(SELECT lam, i, k, w FROM solved UNION SELECT lam, -1, k, w FROM intercept)", "w")
)


def chances(q: Sql, name: str, weights: str) -> str:
    """Softmax chances at weights (k, i, w)."""
    q.add(f"{name}_s", f"SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN {weights} ON i = pos GROUP BY ALL")
    q.add(f"{name}_m", f"SELECT image_id, max(s) AS m FROM {name}_s GROUP BY 1")
    q.add(f"{name}_e", f"SELECT image_id, label, k, exp(s - m) AS e FROM {name}_s JOIN {name}_m USING (image_id)")
    return q.add(
        name,
        f"SELECT image_id, k, CASE WHEN k = label THEN 1 ELSE 0 END - e / sum(e) OVER (PARTITION BY image_id) AS r FROM {name}_e",
    )


def gradient(q: Sql, name: str, residual: str, weights: str, lam: str) -> str:
    q.add(
        f"{name}_g",
        f"SELECT k, pos AS i, sum(v * r) / (SELECT count(*) FROM embeddings) AS g FROM cells JOIN {residual} USING (image_id) GROUP BY 1, 2",
    )
    return q.add(name, f"SELECT k, i, g - {lam} * w AS b FROM {name}_g JOIN {weights} USING (k, i)")


def start(q: Sql) -> None:
    q.values()
    q.add("w0", "SELECT CAST(c AS INTEGER) AS k, CAST(p AS INTEGER) AS i, CAST(0 AS DOUBLE) AS w FROM range(10) a(c), range(64) b(p)")


q = Sql()
start(q)
for step in range(3):
    chances(q, f"c{step}", f"w{step}")
    gradient(q, f"g{step}", f"c{step}", f"w{step}", d(0.01))
    q.add(f"w{step + 1}", f"SELECT k, i, w + {d(1.0 / (step + 1))} * b AS w FROM w{step} JOIN g{step} USING (k, i)")
q.add("out", "SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN w3 ON i = pos GROUP BY ALL")
ORACLES["softmax_gd_steps"] = q.then(long("image_id, label, k AS j", "out", "s"))


def against_rest(q: Sql, steps: int, pull: str) -> None:
    """Descent on a loss of each class against the rest; ``pull`` is its slope at margin y * s."""
    start(q)
    for step in range(steps):
        q.add(f"s{step}", f"SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN w{step} ON i = pos GROUP BY ALL")
        sides = f"SELECT *, CAST(CASE WHEN k = label THEN 1 ELSE -1 END AS DOUBLE) AS y FROM s{step}"
        q.add(f"c{step}", f"SELECT image_id, k, y * {pull} AS r FROM ({sides})")
        gradient(q, f"g{step}", f"c{step}", f"w{step}", d(0.01))
        q.add(f"w{step + 1}", f"SELECT k, i, w + {d(1.0 / (step + 1))} * b AS w FROM w{step} JOIN g{step} USING (k, i)", keep=True)


q = Sql()
against_rest(q, 5, "(1 / (1 + exp(y * s)))")
q.add("out", "SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN w5 ON i = pos GROUP BY ALL")
ORACLES["log_rest_descent"] = q.then(long("image_id, label, k AS j", "out", "s"))

q = Sql()
against_rest(q, 10, "(CASE WHEN y * s < 1 THEN 1 ELSE 0 END)")
q.add("out", "SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN w10 ON i = pos GROUP BY ALL")
ORACLES["hinge_ml"] = q.then(
    "SELECT image_id, label, CAST(k AS INTEGER) AS prediction FROM"
    " (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(s, 9) DESC, k) AS place FROM out) WHERE place = 1"
)

q = Sql()
start(q)
q.add("g_cells", "SELECT a.pos AS i, b.pos AS j, avg(a.v * b.v) AS g FROM cells a JOIN cells b USING (image_id) GROUP BY 1, 2")
q.add("trace", "SELECT sum(g) / 64 AS lam FROM g_cells WHERE i = j")
q.add("gram", "SELECT i, list(g + CASE WHEN i = j THEN lam ELSE 0 END ORDER BY j) AS g, max(CASE WHEN i = j THEN g + lam END) AS diag FROM g_cells, trace GROUP BY 1")
LAM = "(SELECT lam FROM trace)"
for step in range(2):
    chances(q, f"c{step}", f"w{step}")
    gradient(q, f"g{step}", f"c{step}", f"w{step}", LAM)
    descent(q, f"d{step}", "gram", f"g{step}", "k", d(0.0))
    q.add(f"w{step + 1}", f"SELECT k, i, a.w + b.w AS w FROM w{step} a JOIN d{step} b USING (k, i)")
q.add("out", "SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN w2 ON i = pos GROUP BY ALL")
ORACLES["softmax_gn"] = q.then(long("image_id, label, k AS j", "out", "s"))


# The log loss at its least: steps by the inverse of a fixed matrix, (X^T X / n) / 4 + reg, until nothing changes.
q = Sql()
q.values()
q.add("mu", "SELECT pos, avg(v) AS m FROM cells GROUP BY 1")
q.add(
    "x",
    "SELECT image_id, label, pos AS i, v - m AS v FROM cells JOIN mu USING (pos)"
    " UNION BY NAME SELECT vec_id AS image_id, label, 64 AS i, CAST(1 AS DOUBLE) AS v FROM embeddings",
    keep=True,
)
q.add(
    "g_cells",
    f"SELECT a.i, b.i AS j, avg(a.v * b.v) / 4 + CASE WHEN a.i = b.i AND a.i < 64 THEN {d(0.01)} ELSE 0 END AS g FROM x a JOIN x b USING (image_id) GROUP BY 1, 2",
)
q.add("gram", "SELECT i, list(g ORDER BY j) AS g, max(CASE WHEN i = j THEN g END) AS diag FROM g_cells GROUP BY 1")
q.add(
    "unit",
    "SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, CAST(CASE WHEN a.i = b.j THEN 1 ELSE 0 END AS DOUBLE) AS b FROM range(65) a(i), range(65) b(j)",
)
descent(q, "inverse", "gram", "unit", "j", d(0.0), 10, 65)
q.add("rows", "SELECT image_id, label, list(v ORDER BY i) AS f FROM x GROUP BY 1, 2", keep=True)
q.add("turn", "SELECT j, list(w ORDER BY i) AS p FROM inverse GROUP BY 1", keep=True)
LAST = 90
q.add(
    "path",
    f"SELECT 0 AS step, CAST(c AS INTEGER) AS k, [CAST(0 AS DOUBLE) FOR i IN range(65)] AS w FROM range(10) t(c)"
    f" UNION ALL SELECT step + 1, k, list(w[j + 1] + list_dot_product(p, b) ORDER BY j) FROM ("
    f"   SELECT step, k, any_value(w) AS w, list(g - CASE WHEN i < 65 THEN {d(0.01)} ELSE 0 END * own ORDER BY i) AS b FROM ("
    f"     SELECT step, k, any_value(w) AS w, i, avg(r * f[i]) AS g, any_value(w[i]) AS own FROM ("
    f"       SELECT step, k, w, f, CASE WHEN k = label THEN 1 ELSE 0 END - e / sum(e) OVER (PARTITION BY image_id) AS r FROM ("
    f"         SELECT step, k, w, image_id, label, f, exp(list_dot_product(w, f)) AS e FROM path, rows WHERE step < {LAST})), range(1, 66) t(i)"
    f"     GROUP BY step, k, i) GROUP BY step, k), turn GROUP BY step, k",
)
q.add("out", f"SELECT image_id, label, k, list_dot_product(w, f) AS s FROM path, rows WHERE step = {LAST}")
ORACLES["logistic_ml"] = q.then(
    f"SELECT image_id, label, k AS prediction, {shown('s', 4)} AS score FROM"
    " (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, k) AS place FROM out) WHERE place = 1"
)

# Two steps of two solvers under three weights.
q = Sql()
start(q)
q.add("plain", "SELECT a.pos AS i, b.pos AS j, avg(a.v * b.v) AS g FROM cells a JOIN cells b USING (image_id) GROUP BY 1, 2", keep=True)
q.add("trace", "SELECT sum(g) / 64 AS t FROM plain WHERE i = j")
selects = []
for m, reg in enumerate((0.01, 0.1, 1.0)):
    lam = f"({d(reg)} * (SELECT t FROM trace))"
    q.add(f"gram{m}", f"SELECT i, list(g + CASE WHEN i = j THEN {lam} ELSE 0 END ORDER BY j) AS g, max(CASE WHEN i = j THEN g + {lam} END) AS diag FROM plain GROUP BY 1")
    newton = logistic = "w0"
    for step in range(2):
        chances(q, f"c{m}_{step}", newton)
        gradient(q, f"g{m}_{step}", f"c{m}_{step}", newton, lam)
        descent(q, f"d{m}_{step}", f"gram{m}", f"g{m}_{step}", "k", d(0.0), 40 if reg < 0.1 else 20)
        newton = q.add(f"n{m}_{step + 1}", f"SELECT k, i, a.w + b.w AS w FROM {newton} a JOIN d{m}_{step} b USING (k, i)", keep=True)
        q.add(f"s{m}_{step}", f"SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN {logistic} ON i = pos GROUP BY ALL")
        q.add(f"r{m}_{step}", f"SELECT image_id, k, y / (1 + exp(y * s)) AS r FROM (SELECT *, CAST(CASE WHEN k = label THEN 1 ELSE -1 END AS DOUBLE) AS y FROM s{m}_{step})")
        gradient(q, f"h{m}_{step}", f"r{m}_{step}", logistic, d(reg))
        logistic = q.add(f"l{m}_{step + 1}", f"SELECT k, i, w + {d(1.0 / (step + 1))} * b AS w FROM {logistic} JOIN h{m}_{step} USING (k, i)", keep=True)
    for solver, weights in (("softmax_newton", newton), ("log_rest", logistic)):
        selects.append(f"SELECT '{solver}' AS solver, {d(reg)} AS reg, image_id, k AS j, {shown('sum(v * w)')} AS v FROM cells JOIN {weights} ON i = pos GROUP BY image_id, k")
ORACLES["softmax_sweep"] = q.then(" UNION ALL ".join(selects))

ORACLES["param_grid"] = f"""
SELECT reg, mode, mixture, label, n, {shown("1 - mixture + mixture * total / (10 * n)")} AS weight
FROM (SELECT label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM embeddings GROUP BY label),
  (VALUES {regs}) a(reg), (VALUES ('absolute'), ('trace_over_d'), ('trace_over_n')) b(mode), (VALUES ({d(0.0)}), ({d(MIXTURE)})) c(mixture)"""


def block_system(q: Sql, name: str, gram: str, right: str, members: str) -> tuple[str, str]:
    """The equations of the positions in ``members`` (i, place), for ``descent``."""
    q.add(
        f"{name}_gram",
        f"SELECT a.place AS i, list(g ORDER BY b.place) AS g, max(CASE WHEN a.place = b.place THEN g END) AS diag"
        f" FROM {gram} JOIN {members} a USING (i) JOIN {members} b ON b.i = j GROUP BY 1",
        keep=True,
    )
    q.add(f"{name}_right", f"SELECT place AS i, k, b FROM {right} JOIN {members} USING (i)")
    return f"{name}_gram", f"{name}_right"


# Two passes over blocks of 24, 24 and 16 positions.
q = Sql()
moments(q)
q.add("g_kept", "SELECT * FROM g_cells", keep=True)
q.add("b_kept", "SELECT * FROM b_cells", keep=True)
q.add("w0", "SELECT k, i, CAST(0 AS DOUBLE) AS w FROM b_kept")
step = 0
for _ in range(2):
    for low, high in ((0, 24), (24, 48), (48, 64)):
        q.add(f"in{step}", f"SELECT i, i - {low} AS place FROM (SELECT DISTINCT i FROM b_kept) WHERE i >= {low} AND i < {high}")
        q.add(
            f"rest{step}",
            f"SELECT b.k, b.i, any_value(b.b) - coalesce(sum(g * w), 0) AS b FROM b_kept b JOIN g_kept g USING (i)"
            f" JOIN w{step} w ON w.k = b.k AND w.i = g.j AND (w.i < {low} OR w.i >= {high}) GROUP BY b.k, b.i",
        )
        gram, right = block_system(q, f"s{step}", "g_kept", f"rest{step}", f"in{step}")
        descent(q, f"d{step}", gram, right, "k", d(LAMBDA), 14, high - low)
        q.add(
            f"w{step + 1}",
            f"SELECT w.k, w.i, CASE WHEN n.w IS NULL THEN w.w ELSE n.w END AS w FROM w{step} w LEFT JOIN d{step} n ON n.k = w.k AND n.i + {low} = w.i",
            keep=True,
        )
        step += 1
q.add("solved", f"SELECT k, i, w FROM w{step}")
ridge_scores(q)
ORACLES["block_ridge"] = q.then(long("image_id, label, k AS j", "ridge", "s"))

# One Newton step on each shuffled block of 24, 24 and 16 positions.
q = Sql()
start(q)
shuffled(q)
q.add("g_cells", "SELECT a.pos AS i, b.pos AS j, avg(a.v * b.v) AS g FROM cells a JOIN cells b USING (image_id) GROUP BY 1, 2", keep=True)
q.add("trace", "SELECT avg(v * v) AS lam FROM cells")
q.add("g_kept", "SELECT i, j, g + CASE WHEN i = j THEN lam ELSE 0 END AS g FROM g_cells, trace", keep=True)
LAM = "(SELECT lam FROM trace)"
for step, (low, high) in enumerate(((0, 24), (24, 48), (48, 64))):
    q.add(f"in{step}", f"SELECT pos AS i, place - {low} AS place FROM shuffled WHERE place >= {low} AND place < {high}")
    chances(q, f"c{step}", f"w{step}")
    gradient(q, f"g{step}", f"c{step}", f"w{step}", LAM)
    gram, right = block_system(q, f"s{step}", "g_kept", f"g{step}", f"in{step}")
    descent(q, f"d{step}", gram, right, "k", d(0.0), 14, high - low)
    q.add(
        f"w{step + 1}",
        f"SELECT w.k, w.i, w.w + coalesce(n.w, 0) AS w FROM w{step} w LEFT JOIN (SELECT k, in{step}.i, w FROM d{step} JOIN in{step} ON place = d{step}.i) n USING (k, i)",
        keep=True,
    )
q.add("out", "SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN w3 ON i = pos GROUP BY ALL")
ORACLES["softmax_block_gn"] = q.then(long("image_id, label, k AS j", "out", "s"))

# Line search: scores are linear in the step, so every candidate is tried at once.
q = Sql()
start(q)
q.add("tries", "SELECT r, pow(CAST(0.8 AS DOUBLE), r) AS t FROM range(60) x(r)")
for step in range(3):
    chances(q, f"c{step}", f"w{step}")
    gradient(q, f"g{step}", f"c{step}", f"w{step}", d(0.01))
    q.add(f"p{step}", f"SELECT image_id, label, k, sum(v * w) AS s, sum(v * b) AS e FROM cells JOIN w{step} ON i = pos JOIN g{step} USING (k, i) GROUP BY ALL", keep=True)
    q.add(f"l{step}", f"SELECT r, t, image_id, label, k, s + t * e AS s FROM p{step}, (SELECT r, t FROM tries UNION ALL SELECT -1, 0) u")
    q.add(f"n{step}", f"SELECT r, t, image_id, sum(exp(s)) AS z, sum(CASE WHEN k = label THEN exp(s) ELSE 0 END) AS own FROM l{step} GROUP BY ALL")
    q.add(f"e{step}", f"SELECT r, t, avg(-ln(own / z + {d(1e-12)})) AS loss FROM n{step} GROUP BY ALL")
    q.add(f"y{step}", f"SELECT r, t, any_value(loss) + {d(0.005)} * sum((w + t * b) * (w + t * b)) AS f, sum(b * b) AS slope FROM e{step}, w{step} JOIN g{step} USING (k, i) GROUP BY ALL", keep=True)
    q.add(f"t{step}", f"SELECT max(a.t) AS t FROM y{step} a, y{step} z WHERE z.r = -1 AND a.r >= 0 AND a.f <= z.f - {d(0.4)} * a.t * a.slope", keep=True)
    q.add(f"w{step + 1}", f"SELECT k, i, w + t * b AS w FROM w{step} JOIN g{step} USING (k, i), t{step}", keep=True)
q.add("out", "SELECT image_id, label, k, sum(v * w) AS s FROM cells JOIN w3 ON i = pos GROUP BY ALL")
ORACLES["softmax_gd_backtrack"] = q.then(long("image_id, label, k AS j", "out", "s"))

# The whole run: whiten, 32 filters, pool, ridge on 128 features, accuracy.
q = Sql()
q.image("im", 8, 8, 1)
q.patches("raw", "im", 8, 8, 1, 5)
q.add("p", "SELECT image_id, ox, oy, px AS pos, v FROM raw")
whitened(q, "p", "image_id, ox, oy", 0.1, 14)
q.add("shape", f"SELECT i, j, v + CASE WHEN i = j THEN {d(1e-10)} * (SELECT avg(v) FROM w_cov WHERE i = j) ELSE 0 END AS v FROM w_cov")
cholesky(q, "lower", "shape", 25)
q.bank("draw", 32, 25, SEED, 1.2)
q.add("bank", "SELECT f, i AS px, sum(w * v) AS w FROM draw JOIN lower ON j = px GROUP BY f, i")
q.phases("phase", 32, SEED)
q.add("wp", "SELECT image_id, ox, oy, j AS px, v FROM white")
q.conv("out", "wp", "bank", "phase", "offset")
q.pool("pooled", "out", 4, 4, 2, 2, "sum(v) / 4")
q.add("cells", "SELECT image_id, label, CAST(c + x * 32 + y * 64 AS INTEGER) AS pos, v FROM pooled JOIN embeddings ON vec_id = image_id", keep=True)
moments(q, own_cells=False)
q.add("lam", f"SELECT {d(0.1)} * sum(v * v) / 128 AS lam FROM cells")
q.add("ridged", "SELECT i, j, g + CASE WHEN i = j THEN lam ELSE 0 END AS g FROM g_cells, lam", keep=True)
q.add("gram_lam", "SELECT i, list(g ORDER BY j) AS g, max(CASE WHEN i = j THEN g END) AS diag FROM ridged GROUP BY 1")
descent(q, "solved", "gram_lam", "b_cells", "k", d(0.0), 40, 128)
ridge_scores(q)
q.add("ranked", "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, k) - 1 AS place FROM ridge")
ORACLES["featurize_fit_evaluate"] = q.then(
    "SELECT count(*) AS n, round(avg(CASE WHEN place = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy,"
    " round(avg(CASE WHEN place < 5 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS top5_accuracy FROM ranked WHERE k = label"
)

# ---- sources and sinks

HALF = "CASE WHEN label % 2 = 0 THEN 'train' ELSE 'test' END AS split"

q = Sql()
q.values()
ORACLES["feature_text_roundtrip"] = q.then(long(f"image_id, {HALF}, label, pos AS j", "cells"))
ORACLES["float_feature_roundtrip"] = q.then(
    long(f"image_id, {HALF}, label, pos AS j", "cells", f"CAST(CAST(v / {d(3.0)} AS FLOAT) AS DOUBLE)")
)
ORACLES["matrix_csv_roundtrip"] = q.then(
    long("image_id, label, pos AS j", "(SELECT dense_rank() OVER (ORDER BY image_id) - 1 AS image_id, label, pos, v FROM cells)")
)
ORACLES["dataset_roundtrip"] = q.then(long("'e' || image_id AS name, label, pos AS j", "cells"))
ORACLES["split_table_roundtrip"] = q.then(long(f"image_id, {HALF}, label, pos AS j", "cells"))
BYTE = "CAST(floor((v + 1) * 640) AS INTEGER) % 256"
ORACLES["fixed_width_binary_roundtrip"] = q.then(long("image_id, label, pos AS j", "cells", f"{BYTE} / CAST(255 AS DOUBLE)"))
ORACLES["idx_roundtrip"] = q.then(
    long("image_id, label, pos AS j", f"(SELECT dense_rank() OVER (ORDER BY image_id) - 1 AS image_id, label, pos, {BYTE} / CAST(255 AS DOUBLE) AS v FROM cells)")
)
ORACLES["feature_glob"] = q.then(long("image_id, label, pos AS j", "cells"))
ORACLES["whitener_csv_import"] = ORACLES["whitener_roundtrip"]
ORACLES["run_records"] = """
WITH n AS (SELECT c.classes AS n_classes, label, count(*) AS n FROM embeddings, (VALUES (10), (5)) c(classes) WHERE label < c.classes GROUP BY ALL)
SELECT n_classes, 'solve_classes' AS field, CAST(n_classes AS VARCHAR) AS value FROM n GROUP BY n_classes
UNION ALL SELECT n_classes, 'n', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM n GROUP BY n_classes
UNION ALL SELECT n_classes, 'rows_' || label, CAST(n AS VARCHAR) FROM n"""
ORACLES["file_list"] = f"SELECT {HALF}, CAST(sum(strlen(vec_id || ',' || label) + 1) AS BIGINT) AS bytes FROM embeddings GROUP BY 1"
ORACLES["stage_counters"] = """
SELECT 'images' AS stage, count(*) AS n_rows, CAST(count(*) * 16 AS BIGINT) AS n_inside FROM embeddings
UNION ALL SELECT 'patches', CAST(count(*) * 16 AS BIGINT), CAST(count(*) * 16 * 25 AS BIGINT) FROM embeddings"""

# Photos of three sizes, resized to one and sent through a layer.
q = Sql()
q.values()
sizes = []
for k, (w, h) in enumerate(((8, 8), (16, 4), (4, 16))):
    resample(q, f"across{k}", w, 8)
    resample(q, f"down{k}", h, 8)
    sizes.append(
        f"SELECT image_id, a.o AS x, b.o AS y, sum({BYTE} * a.w * b.w) AS v FROM cells JOIN across{k} a ON a.i = pos % {w} JOIN down{k} b ON b.i = pos // {w}"
        f" WHERE image_id % 3 = {k} GROUP BY image_id, a.o, b.o"
    )
q.add("im", f"SELECT image_id, x, y, CAST(c AS INTEGER) AS c, v FROM ({' UNION ALL '.join(sizes)}), range(3) t(c)")
q.patches("p", "im", 8, 8, 3, 3)
q.bank("bank", 4, 27, SEED, 0.05)
q.phases("phase", 4, SEED)
q.conv("out", "p", "bank", "phase", "offset")
q.pool("pooled", "out", 6, 6, 2, 2, "sum(v) / 4")
ORACLES["labelled_photos"] = q.then(
    f"SELECT image_id, label * 2 AS \"class\", CAST(c + x * 4 + y * 12 AS INTEGER) AS j, {shown('v')} AS v FROM pooled JOIN embeddings ON vec_id = image_id"
)

q = Sql()
flat_conv(q, 4)
q.pool("pooled", "out", 4, 4, 2, 2, "sum(v) / 4")
q.add("flat", "SELECT image_id, CAST(c + x * 4 + y * 8 AS INTEGER) AS j, v FROM pooled")
q.add("named", f"SELECT image_id, {shown('v', 9)} AS first FROM flat WHERE j = 0")
ORACLES["layer_reload"] = q.then(
    f"SELECT first, label, {HALF}, 2 AS x_dim, 2 AS y_dim, 4 AS n_channels, j, {shown('v')} AS v"
    " FROM flat JOIN named USING (image_id) JOIN embeddings ON vec_id = image_id"
)

# ---- joins

PAGE_KEY = "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1)"
MAP = "(VALUES ('de', 0), ('en', 1), ('fr', 2)) m(key, class)"
ORACLES["label_map_join"] = f'SELECT page_id, m.key, m.class AS "class" FROM pages JOIN {MAP} ON m.key = {PAGE_KEY}'
ORACLES["label_map_unmapped"] = f"SELECT page_id, {PAGE_KEY} AS key FROM pages WHERE {PAGE_KEY} NOT IN ('de', 'en', 'fr')"
ORACLES["label_map_join_large"] = 'SELECT doc_id AS key, lang, quality AS "class" FROM documents JOIN labels USING (doc_id)'
