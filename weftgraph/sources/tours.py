"""Investigation tours: a small table with one writer, and a JSON side file."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("active", "archived", "stale", "draft")


def newest_tours(raw: DataFrame) -> DataFrame:
    """One row per id: the first in order of created_at, use_count and content."""
    return raw.groupBy("id").agg(F.max_by(F.struct(*[c for c in raw.columns if c != "id"]), F.struct(F.coalesce("use_count", F.lit(0)), F.coalesce("last_used_at", F.lit("")), F.xxhash64("name", "summary"))).alias("x")).select("id", "x.*")


def list_tours(tours: DataFrame, tag: str | None = None, promoted: bool | None = None, status: str | None = None, exclude: str | None = None) -> DataFrame:
    if tag is not None:
        tours = tours.where(F.array_contains("tags", tag))
    if promoted is not None:
        tours = tours.where(F.col("promoted") == promoted)
    if status is not None:
        tours = tours.where(F.col("status") == status)
    if exclude is not None:
        tours = tours.where(F.col("status") != exclude)
    return tours.orderBy(F.desc("created_at"), "id")


def select_tours(tours: DataFrame, tags: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Tours with their place (pos): those of the given ids whatever their status; else the active ones of the given tags, by the first tag that they have; else all active ones (place 0)."""
    if ids:
        return tours.where(F.col("id").isin(*ids)).withColumn("pos", (F.array_position(F.array(*map(F.lit, ids)), F.col("id")) - 1).cast("int"))
    live = tours.where("status = 'active'")
    if not tags:
        return live.withColumn("pos", F.lit(0))
    has = [F.when(F.array_contains("tags", t), i) for i, t in enumerate(tags)]
    return live.withColumn("pos", F.coalesce(*has)).where("pos is not null")


def append_steps(tour_steps: DataFrame, new: DataFrame) -> DataFrame:
    """Steps (id, node, …) of ``new`` whose node the tour lacks; the first of repeated ones by pos."""
    fresh = new.join(tour_steps.select("id", "node").distinct(), ["id", "node"], "left_anti")
    return fresh.groupBy("id", "node").agg(F.min("pos").alias("pos"))


class TourStore:
    """Tours in one JSON file: add, get, list, promote, touch, set status, remove, append steps, the active tour, export and import."""

    def __init__(self, path: str):
        self.path = path
        self.tours: dict[str, dict] = {}
        self.active: str | None = None
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
            self.tours = {t["id"]: t for t in data.get("tours", [])}
            self.active = data.get("active") if data.get("active") in self.tours else None

    def _save(self) -> None:
        beside = f"{self.path}.{uuid.uuid4().hex}"  # written whole, then renamed, so a crash leaves the old file
        with open(beside, "w", encoding="utf-8") as f:
            json.dump({"version": 1, "active": self.active, "tours": list(self.tours.values())}, f, ensure_ascii=False, indent=1)
        os.replace(beside, self.path)

    def add(self, name: str, steps: list[dict], **fields) -> dict:
        now = datetime.now(timezone.utc).isoformat()
        t = {"id": uuid.uuid4().hex[:12], "name": name, "steps": steps, "created_at": now, "status": "active", "promoted": False, "use_count": 0, "tags": [], "keywords": [], "summary": ""} | fields
        t["step_count"] = len(t["steps"])
        self.tours[t["id"]] = t
        self._save()
        return t

    def get(self, tour_id: str) -> dict | None:
        return self.tours.get(tour_id)

    def remove(self, tour_id: str) -> bool:
        found = self.tours.pop(tour_id, None) is not None
        if self.active == tour_id:
            self.active = None
        self._save()
        return found

    def clear(self) -> int:
        n = len(self.tours)
        self.tours, self.active = {}, None
        self._save()
        return n

    def annotate(self, tour_id: str, node: str, text: str) -> int:
        """Put ``text`` on the steps of a node; how many there were."""
        n = 0
        for s in self.tours[tour_id]["steps"]:
            if s["node"] == node:
                s["text"] = text
                n += 1
        self._save()
        return n

    def promote(self, tour_id: str) -> None:
        self.tours[tour_id]["promoted"] = True
        self._save()

    def touch(self, tour_id: str) -> None:
        t = self.tours[tour_id]
        t["use_count"] += 1
        t["last_used_at"] = datetime.now(timezone.utc).isoformat()
        self._save()

    def set_status(self, tour_id: str, status: str) -> None:
        if status not in STATUSES:
            raise ValueError(f"status must be one of {STATUSES}")
        self.tours[tour_id]["status"] = status
        self._save()

    def start(self, tour_id: str | None) -> None:
        self.active = tour_id if tour_id in self.tours else None
        self._save()

    def append(self, tour_id: str, steps: list[dict]) -> tuple[int, int]:
        """(added, skipped): steps whose node the tour has are skipped."""
        t = self.tours[tour_id]
        have = {s["node"] for s in t["steps"]}
        added = 0
        for s in steps:
            if s["node"] not in have:
                have.add(s["node"])
                t["steps"].append(s)
                added += 1
        t["step_count"] = len(t["steps"])
        self._save()
        return added, len(steps) - added

    def export(self) -> dict:
        return {"version": 1, "tours": list(self.tours.values())}

    def load(self, data: dict, overwrite: bool = False) -> int:
        n = 0
        for t in data.get("tours", []):
            if overwrite or t["id"] not in self.tours:
                self.tours[t["id"]] = t
                n += 1
        self._save()
        return n
