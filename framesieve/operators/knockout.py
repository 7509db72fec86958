"""The knockout of a group: a fold over its decisions, in order. Groups are independent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import fold_groups

STATE = "group_id long, images array<string>, left string, right string, pending array<string>, losers array<string>, winner string, extra_winners array<string>, finished boolean, skips int"
#: Snapshots that undo can go back to.
UNDO = 50


class Knockout:
    """A group's state: two members face each other, the others wait."""

    def __init__(self, images: Iterable[str]):
        self.images = list(images)
        self.rejected, self.restored = [], []
        self.losers: list[str] = []
        self.extra_winners: list[str] = []
        self.skips, self.undo_stack = 0, []
        self._start(self.images)

    def _live(self) -> list[str]:
        return [p for p in self.images if p not in self.rejected]

    def reject(self, path: str) -> None:
        """Takes a picture out before the selection; it counts as a loser."""
        if path in self.images and path not in self.rejected:
            self.rejected.append(path)
            self.losers.append(path)
            self._start(self._live())

    def restore(self, path: str) -> None:
        """Puts a rejected picture back; the group starts anew."""
        self.rejected, self.losers = [p for p in self.rejected if p != path], [p for p in self.losers if p != path]
        if path not in self.restored:
            self.restored.append(path)
        self._start(self._live())

    def _start(self, live: list[str]) -> None:
        self.left = self.right = self.winner = None
        self.pending: list[str] = []
        self.finished = len(live) < 2
        if len(live) == 1:
            self.winner = live[0]
        elif live:
            self.left, self.right, *self.pending = live

    def _snapshot(self) -> tuple:
        return self.left, self.right, list(self.pending), list(self.losers), self.winner, list(self.extra_winners), self.finished

    def _refill(self, drained: bool) -> None:
        if self.left is None and self.pending:
            self.left = self.pending.pop(0)
        if self.right is None and self.pending:
            self.right = self.pending.pop(0)
        sides = [s for s in (self.left, self.right) if s is not None]
        if not self.pending and not sides:
            self.finished = True
        elif not self.pending and len(sides) == 1 and not drained:
            self.winner, self.finished = sides[0], True
            self.left = self.right = None

    def _drop(self, left: bool, right: bool, to: list[str]) -> None:
        out = [s for s, go in ((self.left, left), (self.right, right)) if go and s is not None]
        to += out
        self.left, self.right = None if left else self.left, None if right else self.right
        self._refill(drained=left and right)

    def choose(self, loser: str) -> None:
        """Which side loses: left, right, both, or neither (both win)."""
        if self.finished or loser not in ("left", "right", "both", "neither"):
            return
        self._drop(loser != "right", loser != "left", self.extra_winners if loser == "neither" else self.losers)

    def kick(self, side: str) -> None:
        if not self.finished and getattr(self, side, None) is not None:
            self._drop(side == "left", side == "right", self.losers)

    def apply(self, action: str, arg: str | None) -> None:
        if action == "undo":
            if self.undo_stack:
                self.left, self.right, self.pending, self.losers, self.winner, self.extra_winners, self.finished = self.undo_stack.pop()
            return
        self.undo_stack = [*self.undo_stack[-(UNDO - 1) :], self._snapshot()]
        if action == "choose":
            self.choose(arg or "")
        elif action == "kick" and arg in ("left", "right"):
            self.kick(arg)
        elif action == "skip":
            self.skips += 1
        elif action == "reopen":
            self.losers, self.extra_winners = [], []
            self._start(self.images)
        elif action == "reject":
            self.reject(arg or "")
        elif action == "restore":
            self.restore(arg or "")
        elif action == "reset":
            self._start([p for p in (arg or "").split("|") if p])

    def row(self, group_id: int) -> tuple:
        return group_id, self.images, self.left, self.right, self.pending, self.losers, self.winner, self.extra_winners, self.finished, self.skips


def replay(images: DataFrame, decisions: DataFrame) -> DataFrame:
    """State of each group after its decisions.

    images: (group_id, pos, path); decisions: (group_id, seq, action, arg). Decisions of unknown groups have no effect.
    """

    def fold(group_id: object, rows: Iterator[tuple]) -> list[tuple]:
        members, made = [], []
        for _, kind, _, action, arg in rows:
            (members if kind == 0 else made).append((action, arg))
        if not members:
            return []
        state = Knockout(x for x, _ in members)
        for action, arg in made:
            state.apply(action, arg)
        return [state.row(group_id)]

    a = images.select("group_id", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("seq"), F.col("path").alias("action"), F.lit(None).cast("string").alias("arg"))
    b = decisions.select("group_id", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), "action", "arg")
    return fold_groups(a.unionByName(b), "group_id", fold, STATE, ["kind", "seq", "action"])


def initial(images: Column) -> Column:
    """Struct (left, right, pending, winner, finished) of a group before any decision: one picture has won, two face each other."""
    many = F.size(images) > 1
    return F.struct(
        F.when(many, F.try_element_at(images, F.lit(1))).alias("left"), F.when(many, F.try_element_at(images, F.lit(2))).alias("right"),
        F.when(many, F.slice(images, F.lit(3), F.size(images))).otherwise(F.array().cast("array<string>")).alias("pending"), F.when(F.size(images) == 1, F.element_at(images, 1)).alias("winner"), (~many).alias("finished"),
    )


def queue(groups: DataFrame, skips: DataFrame) -> DataFrame:
    """groups (group_id, pos) with ``turn``, by which they come: a skipped one (group_id, seq) goes behind all others, the last skipped last."""
    last = skips.groupBy("group_id").agg(F.max("seq").alias("__seq__"))
    return groups.join(last, "group_id", "left").withColumn("turn", F.struct(F.coalesce("__seq__", F.lit(-1)).alias("skipped"), F.col("pos").alias("pos"))).drop("__seq__")


def member_status(states: DataFrame) -> DataFrame:
    """(group_id, pos, path, status) of each image: winner, loser, current-left, current-right or pending."""
    rows = states.select("*", F.posexplode("images").alias("pos", "path"))
    status = (
        F.when((F.col("path") == F.col("winner")) | F.array_contains("extra_winners", F.col("path")), "winner")
        .when(F.array_contains("losers", F.col("path")), "loser")
        .when(F.col("path") == F.col("left"), "current-left")
        .when(F.col("path") == F.col("right"), "current-right")
        .otherwise("pending")
    )
    return rows.select("group_id", "pos", "path", status.alias("status"))
