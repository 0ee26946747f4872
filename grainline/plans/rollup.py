"""Stored week and month roll-ups of a cache (AGG-3).

A roll-up holds, for each bucket (week or month) and signature (the metrics that
share their independent dimensions, see ``serve``), the SUM over the bucket's days
of each metric's MAX per (day, grain), by every dimension of the grain. Sums of
those are what serving makes of the days, so a request that takes whole buckets
can read them instead. The empty signature is always there: its rows are the
keys.

A roll-up is a cache of its own beside the chart's (same files, versions and
commits). With each bucket its version notes the digest of the days that the
bucket was made of. Hence

  * ``update`` reads only the days of buckets in which a day's digest changed;
  * a bucket is used only while its digest is that of the cache's version that is
    being read. Others are made from their days, so what is served is exact at
    any time: before an update, between two, or when one died;
  * a roll-up of another definition (query, dimensions, derived buckets,
    independence, stored types) is not used, and is made anew.

The rule of ``cover``, coarsest first: a bucket is taken whole if it is fresh, all its
cached days are asked for, not yet covered and in one bucket of the request. The
days left over are read from the cache. Rows without a day are in no roll-up;
a request without dates reads them from the cache.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import bucket_start, time_bucket
from ..functions.derived import applicable_derived, effective_dims
from ..operators import one_pass as P
from ..operators import serve as S
from ..sources import cache as C
from ..sources import manifest as M
from ..spec import ChartSpec, DataRequest, Dim, Metric

DAY = C.DAY
#: Coarsest first, the order in which ``cover`` takes them.
LEVELS = ("month", "week")


# ---------------------------------------------------------------- definition

def _signatures(spec: ChartSpec, dims: list[Dim]) -> dict[frozenset, list[Metric]]:
    names, out = {d.name for d in dims}, {frozenset(): []}
    for m in spec.base_metrics:
        out.setdefault(frozenset(m.independent_of) & names, []).append(m)
    return out


def rollup_spec(spec: ChartSpec, level: str, schema: T.StructType) -> ChartSpec:
    """The roll-up as a chart of its own; ``schema`` is the cache's. Its query is
    no query but says what the rows were made by."""
    if level not in LEVELS:
        raise ValueError(f"a roll-up is of {' or '.join(LEVELS)}, not '{level}'")
    dims = effective_dims(spec, schema.names)
    made_by = (
        level, C.query_hash(spec), schema.json(), [(d.name, d.col) for d in dims], applicable_derived(spec, schema.names),
        [(m.name, m.column, sorted(m.independent_of)) for m in spec.base_metrics],
    )
    return ChartSpec(
        name=f"{spec.name}/rollup_{level}", query=repr(made_by), time_column=None, derived=(),
        dims=(Dim(P.SIGNATURE), *[Dim(d.col) for d in dims]),
        metrics=tuple(Metric(P.metric_column(m.name), column=P.metric_column(m.name)) for m in spec.base_metrics),
    )


def roll(spec: ChartSpec, cache: DataFrame, level: str, signatures: Iterable[frozenset] | None = None) -> DataFrame:
    """The rows of a roll-up: ``_signature``, ``_day`` (the bucket's first day), every
    dimension (null where the signature does not depend on it) and a column for
    each metric. ``level`` may also be ``day``. One scan, an aggregate by day
    and grain and, unless by day, one by bucket."""
    base, dims = S.prepare_base(spec, cache), effective_dims(spec, cache.columns)
    types = {f.name: f.dataType for f in base.schema.fields}
    wanted = _signatures(spec, dims)
    if signatures is not None:
        wanted = {s: m for s, m in wanted.items() if s in set(signatures)}
    none = lambda c: F.lit(None).cast(types[c])
    seen = [
        F.struct(
            F.lit(P.signature_name(s)).alias(P.SIGNATURE), F.col(DAY),
            *[(none(d.col) if d.name in s else F.col(d.col)).alias(d.col) for d in dims],
            *[(F.col(m.column) if m in own else none(m.column)).alias(P.metric_column(m.name)) for m in spec.base_metrics],
        ) for s, own in wanted.items()
    ]
    keys, values = [P.SIGNATURE, DAY, *[d.col for d in dims]], [P.metric_column(m.name) for m in spec.base_metrics]
    rows = base.select(F.explode(F.array(*seen)).alias("r")).select("r.*")
    count = [] if values else [F.count(F.lit(1)).alias("_rows")]
    by_day = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values] or count)
    if level == "day":
        return by_day.select(*keys, *values)
    return by_day.withColumn(DAY, time_bucket(DAY, level)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values] or count).select(*keys, *values)


# ---------------------------------------------------------------- buckets

def _buckets(meta: dict, level: str) -> dict[_dt.date, list[_dt.date]]:
    """The cached days of each bucket, ascending."""
    out: dict[_dt.date, list[_dt.date]] = {}
    for name in sorted(n for n in meta["days"] if n != M.NO_DAY):
        day = _dt.date.fromisoformat(name)
        out.setdefault(bucket_start(day, level), []).append(day)
    return out


def _digest(meta: dict, days: list[_dt.date]) -> str:
    text = ";".join(f"{d} {meta['days'][d.isoformat()]['rows']} {meta['days'][d.isoformat()]['sums']}" for d in days)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _among(wanted: Iterable[_dt.date], known: Iterable[_dt.date]) -> Column:
    """Whether ``_day`` is one of ``wanted``, all of which are among the ``known`` days
    of what is read: one range for each run of known days."""
    wanted, runs, last = set(wanted), [], None
    for i, d in enumerate(sorted(known)):
        if d in wanted:
            if last == i - 1:
                runs[-1][1] = d
            else:
                runs.append([d, d])
            last = i
    return reduce(lambda a, b: a | b, [F.col(DAY).between(F.lit(a), F.lit(b)) for a, b in runs], F.lit(False))


# ---------------------------------------------------------------- upkeep

def update(spark: SparkSession, root: str, spec: ChartSpec, levels: Iterable[str] | None = None) -> dict[tuple[str, str], str]:
    """Bring the chart's roll-ups (``levels``, by default those that it declares) up
    to its newest version. Returns what became of each (level, bucket): new,
    remade, unchanged (its days were not read) or cleared."""
    meta, states = C.read_meta(spark, root, spec), {}
    if meta is None:
        return states
    schema = C.stored_schema(meta)
    for level in spec.rollups if levels is None else levels:
        own = rollup_spec(spec, level, schema)
        held = C.read_meta(spark, root, own)
        if held is not None and held["query_hash"] != C.query_hash(own):
            C.reset_cache(spark, root, own)
            held = None
        have, buckets = (held or {}).get("made_from", {}), _buckets(meta, level)
        made_from = {b.isoformat(): _digest(meta, days) for b, days in buckets.items()}
        for name in sorted(made_from.keys() | have.keys()):
            state = "new" if name not in have else "cleared" if name not in made_from else "unchanged" if have[name] == made_from[name] else "remade"
            states[(level, name)] = state
        changed = [n for (l, n), s in states.items() if l == level and s != "unchanged"]
        if not changed:
            continue
        starts = [_dt.date.fromisoformat(n) for n in changed]
        read = [d for b in starts for d in buckets.get(b, [])]
        days = [d for known in buckets.values() for d in known]
        rows = roll(spec, C.scan_cache(spark, root, spec, version=meta["version"]).where(_among(read, days)), level)

        def noted(version: dict) -> dict:
            kept = {n: v for n, v in version.get("made_from", {}).items() if n not in changed}
            return version | {"made_from": kept | {n: made_from[n] for n in changed if n in made_from}}

        C.write_days(spark, root, own, rows, replace=[(b, b) for b in starts], packed=len(starts) >= C.PACKED_DAYS, amend=noted)
    return states


def update_states(spark: SparkSession, states: dict[tuple[str, str], str]) -> DataFrame:
    """(level, bucket, state) of an update."""
    rows = [(level, _dt.date.fromisoformat(name), state) for (level, name), state in sorted(states.items())]
    return spark.createDataFrame(rows, "level string, bucket date, state string")


def clean_up(spark: SparkSession, root: str, spec: ChartSpec, **kw) -> list[str]:
    """``cache.clean_up`` of the chart's roll-ups."""
    return [f"rollup_{level}/{n}" for level in LEVELS for n in M.clean_up(spark, f"{C.chart_path(root, spec)}/rollup_{level}", **kw)]


# ---------------------------------------------------------------- serving

@dataclass(frozen=True)
class Cover:
    """What a request reads: buckets of roll-ups, and days."""

    buckets: dict[str, list[_dt.date]]
    days: list[_dt.date]


def cover(req: DataRequest, collapse_time: bool, meta: dict, fresh: dict[str, set[_dt.date]]) -> Cover:
    """The coarsest exact cover of the cached days that a request asks for."""
    asked = {d for days in _buckets(meta, "day").values() for d in days
             if (req.from_date is None or d >= req.from_date) and (req.to_date is None or d <= req.to_date)}
    same = lambda b, days: collapse_time or all(bucket_start(d, req.granularity) == bucket_start(b, req.granularity) for d in days)
    taken: dict[str, list[_dt.date]] = {}
    for level in LEVELS if collapse_time or req.granularity != "day" else ():
        for b, days in _buckets(meta, level).items():
            if b in fresh.get(level, ()) and asked.issuperset(days) and same(b, days):
                taken.setdefault(level, []).append(b)
                asked.difference_update(days)
    return Cover(taken, sorted(asked))


def serve_cached(spark: SparkSession, root: str, spec: ChartSpec, req: DataRequest, ordered: bool = True) -> DataFrame:
    """``serve`` of the chart's cache, from its roll-ups as far as these are exact.
    Cache and roll-ups are pinned to the versions found now."""
    meta = C.read_meta(spark, root, spec)
    if meta is None:
        raise ValueError(f"chart '{spec.name}' has no cache")
    schema = C.stored_schema(meta)
    plan = S.resolve(spec, req, schema.names)
    owns, helds, fresh = {}, {}, {}
    for level in LEVELS:
        own = rollup_spec(spec, level, schema)
        held = C.read_meta(spark, root, own)
        if held is not None and held["query_hash"] == C.query_hash(own):
            made_from = held.get("made_from", {})
            owns[level], helds[level] = own, held
            fresh[level] = {b for b, days in _buckets(meta, level).items() if made_from.get(b.isoformat()) == _digest(meta, days)}
    chosen = cover(req, plan.collapse_time, meta, fresh)
    cache = C.scan_cache(spark, root, spec, version=meta["version"])
    if not chosen.buckets:
        return S.serve_plan(plan, cache, ordered=ordered)

    tags = {t.signature or frozenset() for t in P.tags([P.Slice(0, plan)])}
    frames = []
    for level, buckets in chosen.buckets.items():
        known = [_dt.date.fromisoformat(n) for n in helds[level]["days"]]
        frames.append(C.scan_cache(spark, root, owns[level], version=helds[level]["version"]).where(_among(buckets, known)))
    dated = [d for days in _buckets(meta, "day").values() for d in days]
    left = _among(chosen.days, dated)
    if M.NO_DAY in meta["days"] and req.from_date is None and req.to_date is None:
        left = left | F.col(DAY).isNull()
    elif not chosen.days:
        left = None
    if left is not None:
        by_some = frozenset(d for s in tags for d in s)  # filters on other dimensions hold for all signatures
        base = S.prepare_base(spec, cache.where(left))
        common = S._filter_pred(plan, base.schema, exclude=by_some)
        frames.append(roll(spec, S._where(base, common).select(*cache.columns), "day", tags))
    names = [P.SIGNATURE, DAY, *[d.col for d in plan.dims], *[P.metric_column(m.name) for m in spec.base_metrics]]
    rolled = reduce(DataFrame.unionByName, [f.select(*names) for f in frames])
    return _served(replace(plan, req=replace(req, from_date=None, to_date=None)), rolled, ordered)


def _served(plan: S.ServePlan, rolled: DataFrame, ordered: bool) -> DataFrame:
    """A request from rows of roll-ups: those of each signature summed by the
    request's keys. A metric without a key left in a pivot is a scalar."""
    keyless = {s: m for s, m in S._signatures(plan).items() if plan.collapse_time and s >= set(plan.requested_dims)}
    single = {m.name for own in keyless.values() for m in own}
    keyed = replace(plan, needed_base=[n for n in plan.needed_base if n not in single])
    sums = P.slice_sums([P.Slice(0, keyed)], rolled, rolled=True)
    for s, own in keyless.items():
        rows = S._where(rolled.where(F.col(P.SIGNATURE) == P.signature_name(s)), S._filter_pred(plan, rolled.schema, exclude=s))
        columns = [P.metric_column(m.name) for m in own]
        total = rows.agg(*[F.sum(c).alias(c) for c in columns]).select(F.struct(*columns).alias("_r")).scalar()
        sums = sums.withColumns({c: total.getField(c) for c in columns})
    time = [] if plan.collapse_time else [F.col(S.BUCKET).alias(plan.spec.time_column)]
    return S._finished(plan, sums.select(
        *time, *[F.col(plan.col(d)) for d in plan.requested_dims], *[P.output(plan, m).alias(m) for m in S._shown(plan)]), ordered)
