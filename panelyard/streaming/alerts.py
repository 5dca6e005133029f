"""Order-rate alert and circuit breaker with hysteresis."""

from math import prod

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def rate_alerts(orders, limit=5, window="1 second", slide=None, time_column="ts", watermark="10 seconds", by=()):
    """Windows with more than ``limit`` orders. Hot windows are counted map-side first.

    ``watermark`` is how late an order may arrive; windows older than that leave the state and
    their later orders are not counted. None counts every order and keeps every window.
    """
    span = F.window(time_column, window, slide) if slide else F.window(time_column, window)
    timed = orders.withColumn(time_column, F.col(time_column).cast("timestamp"))
    timed = timed.withWatermark(time_column, watermark) if watermark else timed
    counted = timed.groupBy(span, *by).agg(F.count(F.lit(1)).alias("orders"))
    return counted.where(F.col("orders") > limit).select(F.col("window.start").alias("start"), *by, "orders")


class Breaker(StatefulProcessor):
    """Blocks an account after a loss and releases it at the recovery threshold.

    Trips when the day's return falls below -limit, or when the last ``span`` checked
    returns, at least ``least`` of them, compound below -limit. Recovers when the day's or
    the compounded return reaches ``recover``; the row is then checked again. A return is
    remembered only when its own check did not trip. Returns may arrive in any order: a late
    one is checked at its date, and the checks after it are made and reported again. ``keep``
    bounds the dates remembered per account; a return before them starts afresh.
    """

    def __init__(self, limit=0.05, recover=0.0, span=5, least=3, keep=None):
        if recover <= -limit:
            raise ValueError("recover must exceed -limit, or there is no hysteresis")
        self.limit, self.recover, self.span, self.least, self.keep = limit, recover, span, least, keep

    SLOT = 512      # days whose checks share one entry of the state, read and written as a whole

    def init(self, handle):
        # what the first check of a slot starts from, and the returns of the slot
        self.slots = handle.getMapState("slots", "slot long", "tripped boolean, recent array<double>, days array<date>, rets array<double>")

    def put(self, slots, slot, tripped, recent, rets):
        """Store a slot if it changed."""
        if slots.get(slot) != (tripped, recent, rets):
            slots[slot] = (tripped, recent, rets)
            days = sorted(rets)
            self.slots.updateValue((slot,), (tripped, recent, days, [rets[d] for d in days]))

    def step(self, tripped, recent, ret):
        """(tripped, recent, reason) after one return."""
        rolling = prod(1 + r for r in recent) - 1 if len(recent) >= self.least else None
        if tripped and not (ret >= self.recover or (rolling is not None and rolling >= self.recover)):
            return True, recent, "blocked"
        if ret < -self.limit:
            return True, recent, "day_loss"
        recent = (recent + [ret])[-self.span:]
        if len(recent) >= self.least and prod(1 + r for r in recent) - 1 < -self.limit:
            return True, recent, "rolling_loss"
        return False, recent, "recovered" if tripped else ""

    def handleInputRows(self, key, rows, timerValues):
        fresh = {}
        for part in rows:
            for day, now, start in zip(part["date"], part["current_nav"], part["start_nav"]):
                fresh[day] = float((now - start) / start) if start > 0 else 0.0
        slot_of = lambda day: day.toordinal() // self.SLOT
        slots = {k[0]: (v[0], list(v[1]), dict(zip(v[2], v[3]))) for k, v in self.slots.iterator()}
        first, out = min(fresh), []
        # a late return is checked in its place and all later ones again, from the slot that holds the check before it
        before = [s for s, (_, _, rets) in slots.items() if s <= slot_of(first) and min(rets) < first]
        tripped, recent = slots[max(before)][:2] if before else (False, [])
        for slot in sorted({*(s for s in slots if not before or s >= max(before)), *map(slot_of, fresh)}):
            rets = {**slots[slot][2]} if slot in slots else {}
            rets.update((d, r) for d, r in fresh.items() if slot_of(d) == slot)
            self.put(slots, slot, tripped, recent, rets)
            for day in sorted(rets):
                tripped, recent, why = self.step(tripped, recent, rets[day])
                if day >= first:
                    out.append((key[0], day, not tripped, why))
        if self.keep is not None:
            gone = sorted(d for _, _, rets in slots.values() for d in rets)[:-self.keep]
            for slot in sorted({slot_of(d) for d in gone}):
                tripped, recent, rets = slots[slot]
                if max(rets) <= gone[-1]:
                    self.slots.removeKey((slot,))
                    continue
                for day in sorted(d for d in rets if d <= gone[-1]):
                    tripped, recent, _ = self.step(tripped, recent, rets[day])
                self.put(slots, slot, tripped, recent, {d: r for d, r in rets.items() if d > gone[-1]})
        yield pd.DataFrame(out, columns=["account", "date", "allowed", "reason"])

    def close(self):
        pass


BREAKER_SCHEMA = "account string, date date, allowed boolean, reason string"


def circuit_breaker(navs, **limits):
    """navs: account, date, start_nav, current_nav. One row per check; of several for a date the newest batch counts."""
    return navs.groupBy("account").transformWithStateInPandas(
        statefulProcessor=Breaker(**limits), outputStructType=BREAKER_SCHEMA, outputMode="update", timeMode="None")
