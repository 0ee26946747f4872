"""Several slices of one chart, with all their grains, from one scan.

A *slice* is a resolved request; each of its signatures (metrics with the same
independent dimensions, see ``serve``) is a *tag*, and so is its keyset where no
signature can stand for it. Every cache row becomes one row for each tag whose
date range and filters it meets, with the columns of the tag's grain and nulls
for the others. Then all tags of all slices go through the same two aggregates:

  first   by (tag, day, grain): MAX of each metric; for a signature whose rows
          are known to be unique, SUM by (tag, bucket, output key) at once;
          the same for rows of roll-ups (``plans.rollup``), which are sums of MAX
          already and carry the name of their signature
  second  by (tag, bucket, output key): SUM

A slice's rows are those of its left tag; the others' values are handed to them
by a window over the coarser key, which is a lookup without a join: a metric
that does not depend on a dimension repeats across it. Nulls are keys like
others in both aggregates and windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import time_bucket
from . import serve as S

SLICE, TAG, LEFT, TIME, GRAIN_DAY = "_slice", "_tag", "_left", "_t", "_grain_day"
SIGNATURE = "_signature"


@dataclass(frozen=True)
class Slice:
    """A request of a chart and the number its rows carry."""

    number: int
    plan: S.ServePlan


@dataclass(frozen=True)
class Tag:
    slice: Slice
    signature: frozenset | None  # None: the keyset
    left: bool


def tags(slices: list[Slice]) -> list[Tag]:
    out = []
    for s in slices:
        signatures = list(S._signatures(s.plan))
        touched = set(s.plan.requested_dims) | {d for d, v in s.plan.req.filters.items() if v}
        # metrics that depend on every dimension have the slice's own keys always
        left = next((g for g in sorted(signatures, key=len) if not g & touched), None)
        out += [Tag(s, g, g == left) for g in signatures]
        if left is None:
            out.append(Tag(s, None, True))
    return out


def _predicate(tag: Tag, schema, rolled: bool) -> Column | None:
    signature = tag.signature or frozenset()
    preds = [S._date_pred(tag.slice.plan.req), S._filter_pred(tag.slice.plan, schema, exclude=signature)]
    if rolled:
        preds.append(F.col(SIGNATURE) == signature_name(signature))
    out = None
    for p in preds:
        if p is not None:
            out = p if out is None else out & p
    return out


def metric_column(name: str) -> str:
    return f"_v_{name}"


def signature_name(signature: frozenset) -> str:
    """How rows of roll-ups name their signature."""
    return ",".join(sorted(signature))


def slice_sums(slices: list[Slice], cache: DataFrame, extra: DataFrame | None = None, rolled: bool = False) -> DataFrame:
    """The slices' rows: ``_slice``, ``_t`` (the bucket; null for a pivot), a
    column for each requested dimension's column (null where the slice does not
    ask for it) and one for each base metric (``metric_column``; null where the
    slice does not need it). ``extra`` has rows (``_slice``, ``_t``) to be added; then
    ``_left`` is false for these and true for rows of the slices. ``rolled`` says
    that ``cache`` has rows of roll-ups.
    """
    spec, dims = slices[0].plan.spec, slices[0].plan.dims
    base = cache if rolled else S.prepare_base(spec, cache)
    found = tags(slices)
    names = list(dict.fromkeys(n for s in slices for n in s.plan.needed_base))
    metrics = {n: spec.metric(n) for n in names}
    sig_of = {n: frozenset(set(m.independent_of) & {d.name for d in dims}) for n, m in metrics.items()}
    summed = {n for n in names if rolled or spec.unique_grain and not sig_of[n]}
    source = {n: metric_column(n) if rolled else m.column for n, m in metrics.items()}
    types = {f.name: f.dataType for f in base.schema.fields}
    none = lambda c: F.lit(None).cast(types[c])
    requested = {d.col: {s.number for s in slices if d.name in s.plan.requested_dims} for d in dims}

    def at(tag: Tag) -> Column:
        """The row as the tag sees it."""
        plan = tag.slice.plan
        bucket = F.lit(None).cast("date") if plan.collapse_time else time_bucket(F.col(S.DAY), plan.req.granularity)
        own = [] if tag.signature is None else [m.name for m in S._signatures(plan)[tag.signature]]
        at_once = not set(own) - summed
        grain = {d.name for d in dims} - (tag.signature or frozenset())
        keys = set(plan.requested_dims) & grain if at_once else grain
        return F.struct(
            F.lit(tag.slice.number).alias(SLICE), F.lit(found.index(tag)).alias(TAG), F.lit(tag.left).alias(LEFT), bucket.alias(TIME),
            (F.lit(None).cast("date") if at_once else F.col(S.DAY)).alias(GRAIN_DAY),
            *[(F.col(d.col) if d.name in keys else none(d.col)).alias(d.col) for d in dims],
            *[(F.col(c) if n in own else none(c)).alias(metric_column(n)) for n, c in source.items()],
        )

    preds = [_predicate(t, base.schema, rolled) for t in found]
    if all(p is not None for p in preds):
        any_of = preds[0]
        for p in preds[1:]:
            any_of = any_of | p
        base = base.where(any_of)
    seen = [at(t) if p is None else F.when(p, at(t)) for t, p in zip(found, preds)]
    rows = base.select(F.explode(F.array(*seen)).alias("r")).where("r IS NOT NULL").select("r.*")
    columns = {n: metric_column(n) for n in names}
    first = rows.groupBy(SLICE, TAG, LEFT, TIME, GRAIN_DAY, *[d.col for d in dims]).agg(
        F.count(F.lit(1)).alias("_rows"), *[(F.sum(c) if n in summed else F.max(c)).alias(c) for n, c in columns.items()])
    shown = [c for c, who in requested.items() if who]
    if set(names) - summed:
        asked = lambda c: F.col(c) if len(requested[c]) == len(slices) else F.when(F.col(SLICE).isin(sorted(requested[c])), F.col(c))
        sums = first.groupBy(SLICE, TAG, LEFT, TIME, *[asked(c).alias(c) for c in shown]).agg(*[F.sum(c).alias(c) for c in columns.values()] or [F.count(F.lit(1)).alias("_rows")])
    else:
        sums = first
    sums = sums.select(SLICE, TAG, LEFT, TIME, *shown, *columns.values())
    for signature in dict.fromkeys(t.signature for t in found if t.signature and not t.left):
        own = [columns[n] for n in names if sig_of[n] == signature]
        coarse = [d.col for d in dims if d.col in shown and d.name not in signature]
        key = Window.partitionBy(SLICE, TIME, *coarse)
        sums = sums.withColumns({c: F.max(c).over(key) for c in own})
    out = sums.where(LEFT).drop(TAG)
    if extra is not None:
        out = out.unionByName(extra.withColumn(LEFT, F.lit(False)), allowMissingColumns=True)
        return out
    return out.drop(LEFT)


def output(plan: S.ServePlan, name: str) -> Column:
    """A requested metric, formulas included, over the columns of ``slice_sums``."""
    if not plan.spec.metric(name).is_formula:
        return F.col(metric_column(name))
    return plan.formulas[name]({n: F.col(metric_column(n)) for n in plan.needed_base})
