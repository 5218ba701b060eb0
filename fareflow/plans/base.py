"""Frames that many queries share: the mapped tables, cleaned and matched.

Each is written once for a session and folder and read by every later step, as in production; plans
stay short, and a lost executor costs nothing. `forget` has them written anew, for measurements.
"""

from __future__ import annotations

import functools
import re
import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from fareflow.operators import clean, matching, network
from fareflow.sources import fixtures

ROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_SHARED: dict = {}
_LOCKS: dict = {}
_GUARD = threading.Lock()


def folder(spark) -> str:
    """A new folder in the cluster's shared one. Only a local session, as in tests, may go without: it has one machine's temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/fareflow"
    return f"{base.rstrip('/')}/fareflow-{uuid.uuid4().hex}"


def shared(make):
    """Writes a frame once for a session and folder."""

    @functools.wraps(make)
    def get(spark, sf):
        key = make.__module__, make.__name__, spark.sparkContext.applicationId, sf
        with _GUARD:
            lock = _LOCKS.setdefault(key, threading.Lock())
        with lock:
            if key not in _SHARED:
                df, path = make(spark, sf), folder(spark)
                df.write.parquet(path)
                _SHARED[key] = spark.read.schema(df.schema).parquet(path)
            return _SHARED[key]

    return get


def together(spark, sf, *makers) -> None:
    """Has independent shared frames written at the same time, as each alone leaves cores idle."""
    with ThreadPoolExecutor(len(makers)) as threads:
        list(threads.map(lambda make: make(spark, sf), makers))


def cut(df):
    """Writes a frame to the shared folder and reads it back."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget() -> None:
    _SHARED.clear()


def mapped_taps(spark, sf):
    """The mapped taps, each column made once for a row, by a generator.

    Else the filters of cleaning go down into the mapping's joins, with all the text that they look at written out in the joins'
    conditions: code so long that the JVM only interprets it.
    """
    return fixtures.load(spark, sf, "fx_taps").select(F.inline(F.array(F.struct("*"))))


@shared
def raw(spark, sf):
    return mapped_taps(spark, sf)


@shared
def taps(spark, sf):
    return clean.clean_taps(mapped_taps(spark, sf), keep=ROW)


@shared
def known(spark, sf):
    return network.stations(fixtures.load(spark, sf, "fx_nodes"))


@shared
def edges(spark, sf):
    return fixtures.load(spark, sf, "fx_edges")


@shared
def stops(spark, sf):
    return network.line_stops(edges(spark, sf), known(spark, sf))


@shared
def legs(spark, sf):
    return network.legs(stops(spark, sf))


@shared
def subway_pairs(spark, sf):
    return matching.subway_pairs(taps(spark, sf), known(spark, sf), stops(spark, sf), legs(spark, sf))


@shared
def bus_groups(spark, sf):
    return matching.bus_groups(taps(spark, sf))


@shared
def bus_candidates(spark, sf):
    return matching.bus_candidates(bus_groups(spark, sf), stops(spark, sf))


@shared
def bus_pairs(spark, sf):
    frames = bus_groups(spark, sf), known(spark, sf), stops(spark, sf)
    return matching.bus_pairs(*frames, rides=legs(spark, sf), candidates=bus_candidates(spark, sf))


def matched(spark, sf):
    """Not written: the taps and the pairs are, and a query joins only the columns that it needs."""
    together(spark, sf, bus_groups, legs)
    together(spark, sf, subway_pairs, bus_pairs)
    return matching.join_back(taps(spark, sf), subway_pairs(spark, sf), bus_pairs(spark, sf))
