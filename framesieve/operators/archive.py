"""Archive plans: where the files of finished groups go, with companions and free names. Plans are tables; only ``execute`` acts."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, file_name, stem

WINNERS, LOSERS = "winners", "losers"


def transfer_plan(states: DataFrame, companions: DataFrame, existing: DataFrame, root: str = "") -> DataFrame:
    """(group_id, seq, src, dst, kind): winners, extra winners and losers of finished groups, each followed by its companions.

    companions: (primary, companion). A companion takes its primary's new stem and keeps its extension. Names
    that are taken, in existing (path) or by an earlier row, get _1, _2 and so on before the extension.
    """
    def listed(kind: str, folder: str, paths: Column) -> Column:
        return F.transform(paths, lambda p: F.struct(F.lit(kind).alias("kind"), F.lit(folder).alias("folder"), p.alias("src")))

    moves = F.concat(listed("winner", WINNERS, F.filter(F.concat(F.array("winner"), F.col("extra_winners")), lambda p: p.isNotNull())), listed("loser", LOSERS, F.col("losers")))
    main = states.filter("finished").select("group_id", F.posexplode(moves).alias("pos", "m")).select("group_id", "pos", "m.*")
    target = F.concat_ws("/", *[F.lit(root)] * bool(root), F.col("folder"), file_name(F.col("src")))
    main = main.withColumn("want", target)
    with_rank = _freed(main, existing, ["group_id", "pos"])
    side = with_rank.join(companions, F.col("src") == F.col("primary"))
    renamed = F.concat(F.regexp_replace("dst", "\\.[^./]*$", ""), F.regexp_extract("companion", "\\.[^./]*$", 0))
    place = Window.partitionBy("group_id", "pos").orderBy("companion")
    side = side.select("group_id", "pos", F.row_number().over(place).alias("sub"), F.col("companion").alias("src"), renamed.alias("want"), F.concat(F.col("kind"), F.lit("_companion")).alias("kind"))
    side = _freed(side, existing, ["group_id", "pos", "sub"])
    both = with_rank.select("group_id", "pos", F.lit(0).alias("sub"), "src", "dst", "kind").unionByName(side.select("group_id", "pos", "sub", "src", "dst", "kind"))
    seq = F.row_number().over(Window.partitionBy("group_id").orderBy("pos", "sub"))
    return both.select("group_id", seq.alias("seq"), "src", "dst", "kind")


def _freed(rows: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """rows with dst: ``want`` or, where it is taken, with the next free of _1, _2 and so on; equal wants in order."""

    def numbered(path: Column) -> Column:
        """path as itself, and as a numbered form of another name."""
        number = F.regexp_extract(stem(path), "_([0-9]{1,6})$", 1)
        plain = F.struct(path.alias("b"), F.lit(0).alias("n"))
        form = F.struct(F.concat(F.regexp_replace(path, "_[0-9]{1,6}(\\.[^./]*)?$", ""), extension(path)).alias("b"), number.try_cast("int").alias("n"))
        return F.when(number != "", F.array(plain, form)).otherwise(F.array(plain))

    old = existing.select(F.explode(numbered(F.col("path"))).alias("x")).select("x.*")
    new = rows.select("want").distinct().select(F.explode(numbered(F.col("want"))).alias("x")).select("x.*").filter("n > 0")
    taken = old.union(new).groupBy("b").agg(F.collect_set("n").alias("taken"))
    rows = rows.join(taken, F.col("want") == F.col("b"), "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    k = F.row_number().over(Window.partitionBy("want").orderBy(*order))
    rows = rows.withColumn("k", k)
    free = F.filter(F.sequence(F.lit(0), F.col("k") + F.size("taken")), lambda n: ~F.array_contains("taken", n))
    rows = rows.withColumn("k", F.element_at(free, F.col("k")))
    suffixed = F.concat(F.regexp_replace("want", "\\.[^./]*$", ""), F.lit("_"), F.col("k").cast("string"), extension(F.col("want")))
    return rows.withColumn("dst", F.when(F.col("k") == 0, F.col("want")).otherwise(suffixed)).drop("b", "taken", "k")


def revert_plan(transfers: DataFrame, present: DataFrame, moved: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """(group_id, seq, action, src, dst, failure): undoes transfers, the last first; a target that is gone is a failure.

    by: columns of both that tell files of one path apart.
    """
    here = present.select(F.col("path").alias("p"), *[F.col(c).alias(f"__{c}__") for c in by], F.lit(True).alias("there")).distinct()
    same = F.col("dst") == F.col("p")
    for c in by:
        same &= F.col(c) == F.col(f"__{c}__")
    rows = transfers.join(here, same, "left")
    order = Window.partitionBy("group_id").orderBy(F.col("seq").desc())
    action = F.when(F.col("there"), "move back" if moved else "delete")
    return rows.select("group_id", F.row_number().over(order).alias("seq"), action.alias("action"), F.col("dst").alias("src"), F.when(F.lit(moved), F.col("src")).alias("dst"), F.when(F.col("there").isNull(), "target missing").alias("failure"))


def committed(paths: DataFrame, transfers: DataFrame, path: str = "path", by: tuple[str, ...] = ()) -> DataFrame:
    """paths after a move: where a file went, or where it is. by: columns of both that tell files of one path apart."""
    names = [f"__{c}__" for c in by]
    moved = transfers.select(F.col("src").alias("__src__"), F.col("dst").alias("__dst__"), *[F.col(c).alias(n) for c, n in zip(by, names, strict=True)])
    same = F.col(path) == F.col("__src__")
    for c, n in zip(by, names, strict=True):
        same &= F.col(c) == F.col(n)
    return paths.join(moved, same, "left").withColumn(path, F.coalesce("__dst__", path)).drop("__src__", "__dst__", *names)


def committed_states(states: DataFrame, transfers: DataFrame, move: bool) -> DataFrame:
    """states (group_id, winner, extra_winners, losers and more) with ``applied``; after a move, paths are where their files went."""
    done = transfers.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "dst"))).alias("__to__"))
    out = states.join(done, "group_id", "left").withColumn("applied", F.col("__to__").isNotNull())

    def went(path: Column) -> Column:
        return F.coalesce(F.try_element_at("__to__", path), path) if move else path

    return out.withColumns({"winner": went(F.col("winner")), "extra_winners": F.transform("extra_winners", went), "losers": F.transform("losers", went)}).drop("__to__")


def log_rows(transfers: DataFrame) -> DataFrame:
    """What a commit adds to the log: (group_id, seq, kind, src, dst)."""
    return transfers.select("group_id", "seq", "kind", "src", "dst")


def revert(rows: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Carries a revert plan out below folder on this machine; returns (path, reason) of what failed. An action, never part of a query."""
    failed = []
    for r in rows.orderBy("group_id", "seq").toLocalIterator():
        source = os.path.join(folder, r["src"])
        if r["failure"] or not os.path.exists(source):
            failed.append((r["src"], "target missing"))
            continue
        try:
            if r["dst"] is None:
                os.remove(source)
            else:
                target, n = os.path.join(folder, r["dst"]), 0
                base, ending = os.path.splitext(target)
                while os.path.exists(target):
                    n += 1
                    target = f"{base}_{n}{ending}"
                os.rename(source, target)
        except OSError as e:
            failed.append((r["src"], str(e)))
    return failed


def save_state(states: DataFrame, folder: str, version: int) -> str:
    """Writes a session's states as a new version below folder; a reader takes the highest version that is whole."""
    path = f"{folder.rstrip('/')}/state-{version:08}"
    states.write.mode("errorifexists").parquet(path)
    return path


def execute(transfers: DataFrame, folder: str, move: bool = False) -> list[tuple[str, str, str]]:
    """Carries a plan out below folder on this machine, row by row; returns (src, dst, error) of what failed. An action, never part of a query."""
    failed = []
    for r in transfers.orderBy("group_id", "seq").toLocalIterator():
        source, target = os.path.join(folder, r["src"]), os.path.join(folder, r["dst"])
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            (shutil.move if move else shutil.copy2)(source, target)
        except OSError as e:
            failed.append((r["src"], r["dst"], str(e)))
    return failed
