"""Trailing means on the stream against the batch, with pages in any order of arrival."""

from __future__ import annotations

import json
import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.maintain import dedup_pages
from tidemark.operators.rolling import rolling_volume
from tidemark.sources import payloads
from tidemark.streaming import trailing

FIRST = date(2024, 1, 1)
DAY, EPOCH_DAY = 86_400, 19_723  # 2024-01-01


def page(folder, name, days, at):
    """A landed page with the days' volumes, last written at a given second."""
    records = [{"time": (EPOCH_DAY + d) * DAY, "close": 1.0, "volumefrom": 1.0, "volumeto": v} for d, v in days]
    file = folder / name
    file.write_text(json.dumps({"Response": "Success", "Data": {"Data": records}}))
    os.utime(file, (at, at))


def landed(folder, seed):
    """Overlapping fetches, corrections, gaps and missing volumes of several series, in random order of arrival."""
    rng = random.Random(1)  # the same pages for every order
    files = []
    for coin in ("eth", "sol", "gap"):
        for fetch in range(4):
            low = rng.randint(0, 25)
            days = [d for d in range(low, low + rng.randint(5, 20)) if coin != "gap" or d % 7]
            volumes = [(d, None if rng.random() < 0.05 else rng.randint(1, 99) / 4) for d in days]
            half = len(volumes) // 2
            files += [(f"{coin}-btc@2024020{fetch}-0000.json", volumes[half:]), (f"{coin}-btc@2024020{fetch}-0001.json", volumes[: half + 1])]
    files.append(("bad-btc@20240201-0000.json", []))
    random.Random(seed).shuffle(files)
    for at, (name, days) in enumerate(files):
        page(folder, name, days, 1_700_000_000 + at)
    (folder / "broken.json").write_text("{")


def means(rows, column):
    return {(r["coin_id"], r["quote"], r["date"]): None if r[column] is None else round(r[column], 9) for r in rows.collect()}


@pytest.mark.parametrize("seed, files_per_batch", [(1, 3), (2, 100)])
def test_stream_equals_batch_in_any_order(spark, tmp_path, seed, files_per_batch):
    landing, path = tmp_path / "landing", str(tmp_path / "means")
    landing.mkdir()
    landed(landing, seed)
    options = {"window": 4, "files_per_batch": files_per_batch, "checkpoint": str(tmp_path / "ck")}
    trailing.deliver_trailing_means(spark, str(landing), path, **options).awaitTermination()
    records = dedup_pages(payloads.history_records(payloads.read_history_pages(spark, str(landing))))
    want = rolling_volume(records.withColumn("coin_id", F.concat_ws("/", "coin_id", "quote")), 4)
    want = want.withColumn("quote", F.split_part("coin_id", F.lit("/"), F.lit(2))).withColumn("coin_id", F.split_part("coin_id", F.lit("/"), F.lit(1)))
    got = means(trailing.read_trailing_means(spark, path), "mean")
    assert got == means(want, "volume_sma") and sum(v is not None for v in got.values()) > 20
    # A correction that arrives later changes the days behind it, from the state that the first run left.
    page(landing, "eth-btc@20240301-0000.json", [(20, 1000.0), (60, 1.0)], 1_800_000_000)
    trailing.deliver_trailing_means(spark, str(landing), path, **options).awaitTermination()
    again = means(trailing.read_trailing_means(spark, path), "mean")
    changed = {k[2] for k in again if again[k] != got.get(k, "new")}
    assert changed <= {FIRST + timedelta(days=d) for d in (20, 21, 22, 23, 60)} and FIRST + timedelta(days=60) in changed


def test_kept_days_bound_the_state(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "means")
    landing.mkdir()
    page(landing, "eth-btc@20240201-0000.json", [(d, 1.0) for d in range(30)], 1_700_000_000)
    page(landing, "eth-btc@20240202-0000.json", [(10, 99.0), (25, 5.0)], 1_700_000_001)
    query = trailing.deliver_trailing_means(spark, str(landing), path, window=2, files_per_batch=1, checkpoint=str(tmp_path / "ck"), keep_days=10)
    query.awaitTermination()
    got = means(trailing.read_trailing_means(spark, path), "mean")
    assert got["eth", "BTC", FIRST + timedelta(days=10)] == 1.0  # too late
    assert got["eth", "BTC", FIRST + timedelta(days=25)] == got["eth", "BTC", FIRST + timedelta(days=26)] == 3.0
