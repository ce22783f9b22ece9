"""Linking isolated cells with acquisition files by soft logic.

File names carry noisy parts (plate, run tag, drop, well, row and column, date, sequence number) in several
orders. Cells carry the same facts in columns. Candidate pairs share a plate with a drop or a well, or a run tag
with a drop or a sequence place. Every pair is a truth value between 0 and 1 under weighted rules:

* similarity: each attribute pulls the pair's value up to, or down to, its similarity (squared hinges, so that more
  evidence gives more confidence);
* prior: a pair is false unless rules say otherwise;
* exclusivity: the pairs of a cell, and those of a file, sum to one at most;
* transitivity: where a cell and a file are linked, the run's next cell and the next file of the sequence are.

The sum of hinge losses is convex and minimised by alternating directions (consensus ADMM): every rule keeps its own
copy of the values it mentions, moves it in closed form, and the copies are averaged, until primal and dual residuals
are small. Values are confidences; links are taken by value, each cell and file once, until none is left.

Scale: candidates come from equality joins on keys that name a plate or run together with a drop, well or place. The
problem falls into independent parts: pairs whose cell and file have no other candidate and no sequence rule have a
closed form; components (of runs that share candidate files) are solved each in one task while they have at most
``component`` pairs, and larger ones round by round with windows by cell, file and sequence, lineage cut in the shared
folder. Nothing is gathered on the driver.

Defined results: cells without a link or with an ordinal one are sought, files linked by name or by hand are taken;
blanks, pools and control mixes belong to no cell; repeated rows count once, by first delivery; a cell without any
usable attribute, an empty table, or values below ``accept`` give no link; ties go to the smaller file id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protospan.functions.dates import timestamp_of
from protospan.functions.lineage import cut_lineage
from protospan.operators.sequence import first_delivery, positions


@dataclass(frozen=True)
class LinkConfig:
    # weight of pulling up to a similarity, and of pulling down to it
    rules: dict[str, tuple[float, float]] = field(default_factory=lambda: {"tag": (2, 6), "drop": (3, 8), "well": (3, 8), "place": (3, 8), "plate": (1, 1.5), "date": (1, 2)})
    prior: float = 0.2
    exclusive: float = 20.0
    transitive: float = 0.5
    rho: float = 1.0
    rounds: int = 3000  # at most
    tolerance: float = 1e-3  # of the primal and dual residuals
    rounds_per_cut: int = 6
    component: int = 50_000  # pairs that one task may solve
    days: int = 14
    accept: float = 0.5


SUFFIX = r"(?i)(?:[_ \-](?:new|rerun|redo|repeat|copy)| ?\(\d{1,3}\))+$"
NO_CELL = r"(?i)(?:^|[_\-])(?:blank|pool|qc)[a-z]*\d*(?:[_\-]|$)"
PLATE = r"(?i)(?<![A-Z0-9])([A-Z0-9]{3}-?[A-Z0-9]{2}\d{4})(?![A-Z0-9])"
ROWS = "ABCDEFGHIJKLMNOP"


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    x = F.regexp_extract(c, pattern, group)
    return F.when(x != "", x)


def well_key(letter: Column, number: Column) -> Column:
    return F.concat(F.upper(letter), number.cast("int").cast("string"))


def parse_names(files: DataFrame, key: str, name: str) -> DataFrame:
    """file_id, plate_token, tag, drop, well, date, seq of names that can belong to a cell."""
    b = F.col("__b")
    rows = files.select(F.col(key).cast("long").alias("file_id"), F.regexp_replace(F.trim(F.col(name)), SUFFIX, "").alias("__b"), *[c for c in files.columns if c not in (key, name)])
    rows = rows.filter(b.isNotNull() & ~b.rlike(NO_CELL))
    both = r"(?i)-d0*(\d+)-([A-P])0*(\d{1,2})(?=[_\-]|$)"
    grid = r"(?i)[_\-]r0*(\d{1,2})c0*(\d{1,2})(?=[_\-]|$)"
    lone = r"(?i)[_\-]([A-P])-?(\d{1,2})(?=[_\-]|$)"  # two digits at most: G020 is a run tag
    drop = F.coalesce(_part(b, both), _part(b, r"(?i)[_\-]drop0*(\d+)(?=[_\-]|$)")).cast("long")
    by_grid = F.when((_part(b, grid).cast("int") >= 1) & (_part(b, grid).cast("int") <= len(ROWS)), F.concat(F.substring(F.lit(ROWS), _part(b, grid).cast("int"), F.lit(1)), _part(b, grid, 2).cast("int").cast("string")))
    well = F.coalesce(well_key(_part(b, both, 2), _part(b, both, 3)), by_grid, F.when(drop.isNull(), well_key(_part(b, lone), _part(b, lone, 2))))
    return rows.withColumns({
        "plate_token": F.upper(F.regexp_replace(_part(b, PLATE), "-", "")),
        "tag": F.upper(_part(b, r"(?i)_([A-Z0-9]{4})_(?:drop\d+|\d{3,5}(?=_|$))")),
        "drop": drop,
        "well": well,
        "date": timestamp_of(_part(b, r"(?<!\d)(20\d{6})(?!\d)")).cast("date"),
        "seq": _part(b, r"[_\-](\d{3,5})$").cast("long"),
    }).drop("__b")


def _near(token: Column) -> Column:
    """The token and all tokens with one character left out: equal for one change, swap or slip at least once."""
    return F.array_distinct(F.concat(F.array(token), F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))))


def file_plates(files: DataFrame, plates: DataFrame) -> DataFrame:
    """``files`` with plate and s_plate: the stored plate, else plates whose name is at most one slip away."""
    stored = files.filter(F.col("plate_id").isNotNull()).select("*", F.col("plate_id").alias("plate"), F.lit(1.0).alias("s_plate"))
    lost = files.filter(F.col("plate_id").isNull() & F.col("plate_token").isNotNull())
    near = lost.select("*", F.explode(_near(F.col("plate_token"))).alias("__n"))
    names = plates.select(F.col("plate_id").alias("plate"), F.upper(F.col("plate_name")).alias("__name")).filter(F.length("__name") <= 12)  # tokens have nine characters, and no other name is one slip away
    names = names.select("plate", "__name", F.explode(_near(F.col("__name"))).alias("__n"))
    hit = near.join(names, "__n").groupBy(*files.columns, "plate").agg(F.max(F.when(F.col("plate_token") == F.col("__name"), 1.0).otherwise(0.9)).alias("s_plate"))
    gone = files.filter(F.col("plate_id").isNull()).select("*", F.lit(None).cast("long").alias("plate"), F.lit(None).cast("double").alias("s_plate"))
    return stored.unionByName(hit).unionByName(gone)


def cell_facts(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per cell: plate, run, tag, drop, well, day, place in the run, link."""
    own = first_delivery(cells, "cell_id", "loaded_at", ["cell_id", "cellenone_run_id", "plate_id", "drop_no", "target_well", "x_pos", "y_pos", "raw_file_id", "link_method"])
    r = first_delivery(runs, "cellenone_run_id", "loaded_at", ["cellenone_run_id", "plate_id", "run_uid", "run_date"])
    r = r.select(F.col("cellenone_run_id").alias("__run"), F.col("plate_id").alias("__plate"), F.upper(F.substring("run_uid", 1, 4)).alias("tag"), timestamp_of(F.col("run_date")).cast("date").alias("day"))
    text = r"(?i)^\s*([A-P])[\s_\-]*0*(\d{1,2})\s*$"
    col, row = F.col("x_pos").cast("int"), F.col("y_pos").cast("int")
    placed = F.when((row >= 1) & (row <= len(ROWS)) & (col >= 1), F.concat(F.substring(F.lit(ROWS), row, F.lit(1)), col.cast("string")))
    own = own.select(
        F.col("cell_id").cast("long").alias("cell_id"), F.col("cellenone_run_id").cast("long").alias("run"), F.col("plate_id").cast("long").alias("plate_id"), F.col("drop_no").cast("long").alias("drop"),
        F.coalesce(well_key(_part(F.col("target_well"), text), _part(F.col("target_well"), text, 2)), placed).alias("well"),
        F.col("raw_file_id").cast("long").alias("linked"), F.lower(F.trim("link_method")).alias("method"),
    )
    place = positions(own.filter(F.col("run").isNotNull() & F.col("drop").isNotNull()).select("cell_id", "run", "drop"), "run", "drop", "cell_id", name="place")
    own = own.join(place.select("cell_id", "place"), "cell_id", "left")
    return own.join(r, F.col("run") == F.col("__run"), "left").withColumn("plate", F.coalesce("plate_id", "__plate")).drop("__run", "__plate", "plate_id")


def candidates(cells: DataFrame, files: DataFrame, plates: DataFrame, runs: DataFrame, c: LinkConfig) -> DataFrame:
    """cell_id, file_id, run, place, seq and a similarity per rule (null where a side lacks the fact)."""
    facts = cell_facts(cells, runs)
    raw = first_delivery(files, "raw_file_id", "loaded_at", ["raw_file_id", "raw_file_name", "plate_id"])
    named = parse_names(raw, "raw_file_id", "raw_file_name").withColumn("plate_id", F.col("plate_id").cast("long"))
    fixed = F.col("method").isin("name", "manual") & F.col("linked").isNotNull()
    anchors = facts.filter(fixed & F.col("place").isNotNull()).select("run", "place", "linked").join(named.filter(F.col("seq").isNotNull() & F.col("tag").isNotNull() & F.col("drop").isNull()).select(F.col("file_id").alias("linked"), "seq"), "linked")
    shift = anchors.groupBy("run", (F.col("seq") - F.col("place")).alias("shift")).agg(F.count("*").alias("n")).groupBy("run").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    # a run without an anchor: its numbers fix the shift where the first and last cell have files
    extent = named.filter(F.col("seq").isNotNull() & F.col("tag").isNotNull() & F.col("drop").isNull()).groupBy("tag", "plate_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    size = facts.filter(F.col("place").isNotNull()).groupBy("run", "tag", "plate").agg(F.count("*").alias("cells"))
    guess = size.join(extent, (size["tag"] == extent["tag"]) & (size["plate"] == extent["plate_id"])).filter(F.col("hi") - F.col("lo") + 1 == F.col("cells")).groupBy("run").agg(F.min("lo").alias("guess"))
    open_cells = facts.filter(F.col("linked").isNull() | (F.col("method") == "ordinal")).join(shift, "run", "left").join(guess, "run", "left").withColumn("at", F.col("place") + F.coalesce("shift", "guess"))
    taken = facts.filter(fixed).select(F.col("linked").alias("file_id")).distinct()
    plate_rows = first_delivery(plates, "plate_id", "loaded_at", ["plate_id", "plate_name"]).withColumn("plate_id", F.col("plate_id").cast("long"))
    free = file_plates(named.join(taken, "file_id", "left_anti"), plate_rows)

    def key(kind: str, a: str, b: str) -> Column:
        return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws("|", F.lit(kind), F.col(a).cast("string"), F.col(b).cast("string")))

    left = open_cells.select("cell_id", "run", "place", "at", F.col("tag").alias("c_tag"), F.col("drop").alias("c_drop"), F.col("well").alias("c_well"), F.col("plate").alias("c_plate"), "day",
                             F.explode(F.array_compact(F.array(key("d", "plate", "drop"), key("w", "plate", "well"), key("t", "tag", "drop"), key("s", "tag", "at")))).alias("__k"))
    right = free.select("file_id", "tag", "drop", "well", "date", "seq", "plate", "s_plate",
                        F.explode(F.array_compact(F.array(key("d", "plate", "drop"), key("w", "plate", "well"), key("t", "tag", "drop"), F.when(F.col("drop").isNull(), key("s", "tag", "seq"))))).alias("__k"))
    pairs = left.join(right, "__k")
    same = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.col(a) == F.col(b)).cast("double"))
    gap = F.datediff("date", "day")
    by_place = F.col("tag").isNotNull() & F.col("drop").isNull()
    sims = {
        "tag": same("tag", "c_tag"),
        "drop": same("drop", "c_drop"),
        "well": same("well", "c_well"),
        "place": F.when(by_place, same("seq", "at")),
        "plate": F.when(F.col("plate") == F.col("c_plate"), F.col("s_plate")).when(F.col("plate").isNotNull() & F.col("c_plate").isNotNull(), 0.0),
        "date": F.when((gap >= 0) & (gap <= c.days), 1.0).when(gap.isNotNull(), 0.1),
    }
    scored = pairs.select("cell_id", "file_id", "run", "place", F.when(by_place, F.col("seq")).alias("seq"), *[s.alias(f"s_{k}") for k, s in sims.items()])
    return scored.groupBy("cell_id", "file_id").agg(*[F.max(x).alias(x) for x in ("run", "place", "seq", *[f"s_{k}" for k in sims])])


def _rules(c: LinkConfig) -> list[tuple[str, float, float]]:
    """(similarity, weight up, weight down); the prior pulls down to 0."""
    return [("s_prior", 0.0, c.prior), *((f"s_{k}", up, down) for k, (up, down) in c.rules.items())]


def _lone(c: LinkConfig) -> Column:
    """The value that minimises the squared hinges of a pair without rivals: between two similarities next to each other it is a weighted mean."""
    pots = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("s"), F.lit(float(up)).alias("up"), F.lit(float(down)).alias("down"))) for k, up, down in _rules(c)]))
    corners = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform(pots, lambda q: q["s"]))))
    pull = lambda q, at: F.when(q["s"] > at, q["up"]).otherwise(q["down"])

    def mean(at: Column) -> Column:
        total = F.aggregate(pots, F.lit(0.0), lambda a, q: a + pull(q, at))
        return F.when(total > 0, F.aggregate(pots, F.lit(0.0), lambda a, q: a + pull(q, at) * q["s"]) / total).otherwise(at)

    def loss(y: Column) -> Column:
        return F.aggregate(pots, F.lit(0.0), lambda a, q: a + q["up"] * F.pow(F.greatest(F.lit(0.0), q["s"] - y), 2) + q["down"] * F.pow(F.greatest(F.lit(0.0), y - q["s"]), 2))

    tried = F.concat(corners, F.transform(corners, mean))
    return F.array_min(F.transform(tried, lambda y: F.struct(loss(y).alias("l"), y.alias("y"))))["y"]


def _along(place: np.ndarray, seq: np.ndarray, run: np.ndarray, cell: np.ndarray, file: np.ndarray) -> np.ndarray:
    """Pairs (i, j): j is the run's next place with the next number of the sequence."""
    ok = np.flatnonzero(~np.isnan(place) & ~np.isnan(seq) & ~np.isnan(run))
    order = ok[np.lexsort((file[ok], cell[ok], place[ok], (seq - place)[ok], run[ok]))]
    a, b = order[:-1], order[1:]
    near = (run[a] == run[b]) & ((seq - place)[a] == (seq - place)[b]) & (place[b] == place[a] + 1)
    return np.stack([a[near], b[near]])


def admm(cell: np.ndarray, file: np.ndarray, sims: np.ndarray, up: np.ndarray, down: np.ndarray, links: np.ndarray, c: LinkConfig) -> tuple[np.ndarray, int, float]:
    """Values of the pairs of one component, rounds taken and the larger of the last primal and dual residual.

    Every potential keeps a copy of the values it mentions, moves it in closed form, and the copies are averaged.
    ``sims``: pairs x rules, NaN where a side lacks the fact; ``links``: pairs of pairs that the sequence ties.
    """
    n, seen = len(cell), ~np.isnan(sims)
    s = np.where(seen, sims, 0.0)
    _, ci = np.unique(cell, return_inverse=True)
    _, fi = np.unique(file, return_inverse=True)
    nc, nf = np.bincount(ci)[ci], np.bincount(fi)[fi]
    a, b = links
    copies = seen.sum(1) + 2.0 + np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    z, u = np.full(n, 0.5), np.zeros_like(s)
    uc, uf, ua, ub = np.zeros(n), np.zeros(n), np.zeros(len(a)), np.zeros(len(b))
    rho, ex, tr = c.rho, c.exclusive / c.rho, c.transitive / c.rho
    gap = np.inf
    for done in range(1, c.rounds + 1):
        v = z[:, None] - u
        w = 2 * np.where(v < s, up, down) / rho
        x = np.where(seen, (v + w * s) / (1 + w), 0.0)
        vc, vf = z - uc, z - uf
        xc = vc - np.minimum(ex, np.maximum(0.0, (np.bincount(ci, vc)[ci] - 1) / nc))
        xf = vf - np.minimum(ex, np.maximum(0.0, (np.bincount(fi, vf)[fi] - 1) / nf))
        d = (z[a] - ua) - (z[b] - ub)
        move = np.sign(d) * np.minimum(tr, np.abs(d) / 2)
        xa, xb = z[a] - ua - move, z[b] - ub + move
        total = np.where(seen, x + u, 0.0).sum(1) + xc + uc + xf + uf + np.bincount(a, xa + ua, n) + np.bincount(b, xb + ub, n)
        new = np.clip(total / copies, 0.0, 1.0)
        u += np.where(seen, x - new[:, None], 0.0)
        uc, uf, ua, ub = uc + xc - new, uf + xf - new, ua + xa - new[a], ub + xb - new[b]
        primal = max(np.abs(np.where(seen, x - new[:, None], 0.0)).max(initial=0.0), np.abs(xc - new).max(initial=0.0), np.abs(xf - new).max(initial=0.0), np.abs(xa - new[a]).max(initial=0.0), np.abs(xb - new[b]).max(initial=0.0))
        gap, z = max(primal, rho * np.abs(new - z).max(initial=0.0)), new
        if gap < c.tolerance:
            break
    return z, done, float(gap)


def assign(cell: np.ndarray, file: np.ndarray, y: np.ndarray, accept: float) -> np.ndarray:
    """Which pairs become links: by value, then file and cell, each cell and file once, until none is left."""
    keep, cells, files = np.zeros(len(y), bool), set(), set()
    value = np.round(y, 6)
    for i in np.lexsort((cell, file, -value)):
        if value[i] >= accept and cell[i] not in cells and file[i] not in files:
            keep[i] = True
            cells.add(cell[i])
            files.add(file[i])
    return keep


def components(pairs: DataFrame) -> DataFrame:
    """node, comp: runs (or cells without one) that share candidate files, by the smallest node; the graph has a row per run and file."""
    edges = cut_lineage(pairs.select("node", "file_id").distinct())
    labels = cut_lineage(edges.select("node").distinct().withColumn("comp", F.col("node")))
    while True:
        by_file = edges.join(labels, "node").groupBy("file_id").agg(F.min("comp").alias("__m"))
        new = edges.join(by_file, "file_id").groupBy("node").agg(F.min("__m").alias("__c"))
        jump = labels.select(F.col("node").alias("__c"), F.col("comp").alias("__j"))  # the label's own label, so that chains shrink by half
        new = cut_lineage(labels.join(new, "node").join(jump, "__c").select("node", F.least("__c", "__j").alias("__n"), F.col("comp").alias("__old")))
        labels = new.select("node", F.col("__n").alias("comp"))
        if new.filter("__n <> __old").isEmpty():
            return labels


SOLVED = "cell_id long, file_id long, y double, linked boolean, rounds int, gap double"


def solve(pairs: DataFrame, c: LinkConfig) -> DataFrame:
    """cell_id, file_id, y, linked, rounds, gap: the value that minimises the sum of all rules, and the links by value.

    The problem falls into independent parts. Pairs without rivals and sequence are solved in closed form; components of
    up to ``component`` pairs one by one in tasks; larger ones round by round over DataFrames.
    """
    by_cell, by_file = Window.partitionBy("cell_id"), Window.partitionBy("file_id")
    p = pairs.withColumn("s_prior", F.lit(0.0)).withColumn("__nc", F.count("*").over(by_cell)).withColumn("__nf", F.count("*").over(by_file))
    p = cut_lineage(p.withColumn("node", F.coalesce(F.col("run").cast("string"), F.concat(F.lit("c"), F.col("cell_id").cast("string")))))
    lone = (F.col("__nc") == 1) & (F.col("__nf") == 1) & F.col("seq").isNull()
    alone = p.filter(lone).select("cell_id", "file_id", _lone(c).alias("y")).select("cell_id", "file_id", "y", (F.round("y", 6) >= c.accept).alias("linked"), F.lit(0).alias("rounds"), F.lit(0.0).alias("gap"))
    rest = p.filter(~lone)
    member = cut_lineage(rest.join(components(rest), "node").withColumn("__size", F.count("*").over(Window.partitionBy("comp"))))
    rules = _rules(c)
    up, down = np.array([r[1] for r in rules]), np.array([r[2] for r in rules])

    def part(g: pd.DataFrame) -> pd.DataFrame:
        cell, file = g["cell_id"].to_numpy(np.int64), g["file_id"].to_numpy(np.int64)
        place, seq, run = (g[k].to_numpy(float) for k in ("place", "seq", "run"))
        sims = np.stack([g[k].to_numpy(float) for k, _, _ in rules], 1)
        y, rounds, gap = admm(cell, file, sims, up, down, _along(place, seq, run, cell, file), c)
        return pd.DataFrame({"cell_id": cell, "file_id": file, "y": y, "linked": assign(cell, file, y, c.accept), "rounds": rounds, "gap": gap})

    out = alone.unionByName(member.filter(F.col("__size") <= c.component).groupBy("comp").applyInPandas(part, SOLVED))
    large = member.filter(F.col("__size") > c.component)
    return out if large.isEmpty() else out.unionByName(solve_large(large, c))


def solve_large(pairs: DataFrame, c: LinkConfig) -> DataFrame:
    """``admm`` and ``assign`` over DataFrames, for components that no task should hold: windows by cell, file and sequence, lineage cut as rounds go."""
    rules, rho, ex, tr = _rules(c), c.rho, c.exclusive / c.rho, c.transitive / c.rho
    by_cell, by_file = Window.partitionBy("cell_id"), Window.partitionBy("file_id")
    pots = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("s"), F.lit(float(a)).alias("up"), F.lit(float(b)).alias("down"))) for k, a, b in rules]))
    z = pairs.select("cell_id", "file_id", "run", "place", "seq", pots.alias("pots"), "__nc", "__nf").withColumn("z", F.lit(0.5)).withColumn("u", F.transform("pots", lambda q: F.lit(0.0)))
    for x in ("uc", "uf", "un", "up"):
        z = z.withColumn(x, F.lit(0.0))
    along = Window.partitionBy("run", F.col("seq") - F.col("place")).orderBy("place", "cell_id", "file_id")  # streamed, one row ahead and behind
    tied = F.col("seq").isNotNull() & F.col("run").isNotNull()
    z = z.withColumn("__next", F.coalesce((F.lead("place").over(along) == F.col("place") + 1) & tied, F.lit(False)))
    z = z.withColumn("__prev", F.coalesce((F.lag("place").over(along) == F.col("place") - 1) & tied, F.lit(False))).withColumn("gap", F.lit(0.0))
    held, done = z.columns, 0
    while done < c.rounds:
        for _ in range(c.rounds_per_cut):
            v = lambda u: F.col("z") - F.col(u)
            s = z.withColumns({"__sc": F.sum(v("uc")).over(by_cell), "__sf": F.sum(v("uf")).over(by_file), "__vn": F.lead(v("up")).over(along), "__vp": F.lag(v("un")).over(along)})

            def agree(u: str, other: str, on: str) -> Column:
                d = v(u) - F.col(other)
                return F.when(F.col(on), v(u) - F.signum(d) * F.least(F.lit(tr), F.abs(d) / 2)).otherwise(v(u))

            def step(q: Column, u: Column) -> Column:
                at = F.col("z") - u
                w = 2 * F.when(at < q["s"], q["up"]).otherwise(q["down"]) / rho
                return (at + w * q["s"]) / (1 + w)

            s = s.withColumns({
                "xc": v("uc") - F.least(F.lit(ex), F.greatest(F.lit(0.0), (F.col("__sc") - 1) / F.col("__nc"))),
                "xf": v("uf") - F.least(F.lit(ex), F.greatest(F.lit(0.0), (F.col("__sf") - 1) / F.col("__nf"))),
                "xn": agree("un", "__vn", "__next"), "xp": agree("up", "__vp", "__prev"), "x": F.zip_with("pots", "u", step),
            })
            copies = F.size("pots") + 2 + F.col("__next").cast("int") + F.col("__prev").cast("int")
            total = F.aggregate(F.zip_with("x", "u", lambda x, u: x + u), F.lit(0.0), lambda a, b: a + b) + F.col("xc") + F.col("uc") + F.col("xf") + F.col("uf")
            total = total + F.when(F.col("__next"), F.col("xn") + F.col("un")).otherwise(0.0) + F.when(F.col("__prev"), F.col("xp") + F.col("up")).otherwise(0.0)
            s = s.withColumn("__z", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / copies)))
            off = [F.abs(F.col(x) - F.col("__z")) for x in ("xc", "xf")] + [F.when(F.col(on), F.abs(F.col(x) - F.col("__z"))).otherwise(0.0) for x, on in (("xn", "__next"), ("xp", "__prev"))]
            s = s.withColumn("gap", F.greatest(*off, F.aggregate("x", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x - F.col("__z")))), rho * F.abs(F.col("__z") - F.col("z"))))
            s = s.withColumns({"u": F.zip_with("x", "u", lambda x, u: u + x - F.col("__z")), **{u: F.col(u) + F.col(x) - F.col("__z") for x, u in (("xc", "uc"), ("xf", "uf"), ("xn", "un"), ("xp", "up"))}})
            z = s.withColumn("z", F.col("__z")).select(*held)
            done += 1
        z = cut_lineage(z)
        if z.agg(F.max("gap")).first()[0] < c.tolerance:
            break
    value = F.round("z", 6)
    left = z.select("cell_id", "file_id", value.alias("v")).filter(F.col("v") >= c.accept)
    won = left.select("cell_id", "file_id").limit(0)
    while not left.isEmpty():  # the best pair of all goes in each round
        best = left.withColumn("__c", F.row_number().over(by_cell.orderBy(F.desc("v"), "file_id"))).withColumn("__f", F.row_number().over(by_file.orderBy(F.desc("v"), "cell_id")))
        now = cut_lineage(best.filter("__c = 1 AND __f = 1").select("cell_id", "file_id"))
        won = cut_lineage(won.unionByName(now))
        left = cut_lineage(left.join(now.select("cell_id"), "cell_id", "left_anti").join(now.select("file_id"), "file_id", "left_anti"))
    out = z.join(won.withColumn("linked", F.lit(True)), ["cell_id", "file_id"], "left")
    return out.select("cell_id", "file_id", F.col("z").alias("y"), F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(done).alias("rounds"), "gap")


def link(cells: DataFrame, files: DataFrame, plates: DataFrame, runs: DataFrame, c: LinkConfig | None = None) -> DataFrame:
    """(cell_id, raw_file_id, confidence): pairs of at least ``accept``, best value first, until none is left."""
    c = c or LinkConfig()
    got = solve(candidates(cells, files, plates, runs, c), c).filter("linked")
    return got.select("cell_id", F.col("file_id").alias("raw_file_id"), F.round("y", 4).alias("confidence"))
