"""Per-key state over sample streams: counters, delay variation, reachability.

One small record per key lives in the state store. Each micro-batch of a key is
put in time order; rows older than the stored state are passed on without a
change of state and without derived values.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.operators.counters import COUNTERS, OVERFLOW_SHARE

STATE_ORDER = "timestamp timestamp_ntz, row_no bigint"


def _apply(stream: DataFrame, keys: list[str], processor, output: str) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="None")


def _processor(state_schema: str, step):
    """A processor that keeps one record per key; ``step(rows, record) -> (output rows, new record)``.

    The class is local so that workers receive it by value.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class KeyedState(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", state_schema)

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows), ignore_index=True).sort_values(["timestamp", "row_no"], kind="stable")
            record = self.last.get() if self.last.exists() else None
            out, record = step(batch, record)
            if record is not None:
                self.last.update(record)
            yield out

        def close(self) -> None:
            pass

    return KeyedState()


def stream_counter_delta(stream: DataFrame, maxima: Mapping[str, int] | None = None) -> DataFrame:
    """Counter increases against the last valid row of the interface."""
    names = [c for c in COUNTERS if c in stream.columns]
    limits, share = dict(maxima or {}), OVERFLOW_SHARE

    def step(batch, record):
        rows = []
        for row in batch.itertuples(index=False):
            base = [row.run_id, row.interface, row.timestamp, row.row_no]
            late = record is not None and (row.timestamp, row.row_no) <= (record[0], record[1])
            if row.sample_status != "ok":
                rows.append(base + [None] * len(names) + ["unavailable"])
                continue
            if late:
                rows.append(base + [None] * len(names) + ["late"])
                continue
            # counters arrive as text: pandas would turn a column with nulls into doubles
            now = [None if (text := getattr(row, n)) is None else int(text) for n in names]
            if record is None:
                rows.append(base + [None] * len(names) + ["initial"])
            else:
                deltas, kinds = [], set()
                for n, value, before in zip(names, now, record[2:]):
                    if value is None or before is None:
                        deltas.append(None)
                        continue
                    wraps = n in limits and before > int(limits[n] * share)
                    if value < before:
                        kinds.add("overflow" if wraps else "reset")
                    deltas.append(value - before if value >= before else limits[n] - before + value + 1 if wraps else None)
                rows.append(base + deltas + ["+".join(sorted(kinds)) or "normal"])
            record = (row.timestamp, row.row_no, *now)
        import pandas as pd
        out = pd.DataFrame(rows, columns=["run_id", "interface", "timestamp", "row_no", *[f"{n}_delta" for n in names], "counter_event"])
        for n in names:
            out[f"{n}_delta"] = pd.array(out[f"{n}_delta"].tolist(), dtype="Int64")
        return out, record

    state = ", ".join([STATE_ORDER, *[f"{n} bigint" for n in names]])
    output = ", ".join(["run_id string, interface string, timestamp timestamp_ntz, row_no bigint",
                        *[f"{n}_delta bigint" for n in names], "counter_event string"])
    texts = [F.col(n).cast("bigint").cast("string").alias(n) for n in names]
    return _apply(stream.select("run_id", "interface", "timestamp", "row_no", "sample_status", *texts),
                  ["run_id", "interface"], _processor(state, step), output)


def stream_delay_variation(stream: DataFrame) -> DataFrame:
    """Absolute RTT change against the last known RTT of the target."""
    def step(batch, record):
        known = batch["rtt_ms"].notna()
        if record is not None:
            newer = (batch["timestamp"] > record[0]) | ((batch["timestamp"] == record[0]) & (batch["row_no"] > record[1]))
            known &= newer
        rtt = batch["rtt_ms"].where(known)
        before = rtt.ffill().shift()
        if record is not None:
            before = before.fillna(record[2])
        out = batch[["run_id", "target", "timestamp", "row_no"]].assign(delay_variation_ms=(rtt - before).abs())
        if known.any():
            last = batch[known].iloc[-1]
            record = (last["timestamp"], int(last["row_no"]), float(last["rtt_ms"]))
        return out, record

    return _apply(stream.select("run_id", "target", "timestamp", "row_no", "rtt_ms"), ["run_id", "target"],
                  _processor(f"{STATE_ORDER}, rtt_ms double", step),
                  "run_id string, target string, timestamp timestamp_ntz, row_no bigint, delay_variation_ms double")


def stream_transitions(stream: DataFrame) -> DataFrame:
    """Changes of reachability per target; rows older than the state come out as ``late``, so they can be counted."""
    def step(batch, record):
        import pandas as pd
        late = batch.iloc[:0]
        if record is not None:
            newer = (batch["timestamp"] > record[0]) | ((batch["timestamp"] == record[0]) & (batch["row_no"] > record[1]))
            batch, late = batch[newer], batch[~newer]
        up = batch["reachability"].astype(bool)
        before = up.astype("boolean").shift()
        if record is not None and len(batch):
            before.iloc[0] = bool(record[2])
        kind = before.map({True: "became_unreachable", False: "recovered"}).where(before.notna(), "initially_unreachable")
        changed = (before.notna() & (before != up)) | (before.isna() & ~up)
        out = batch[["run_id", "target", "timestamp", "row_no"]].assign(transition=kind.astype(object))[changed.fillna(False).astype(bool)]
        if len(batch):
            last = batch.iloc[-1]
            record = (last["timestamp"], int(last["row_no"]), bool(last["reachability"]))
        if len(late):
            out = pd.concat([out, late[["run_id", "target", "timestamp", "row_no"]].assign(transition="late")])
        return out, record

    return _apply(stream.select("run_id", "target", "timestamp", "row_no", "reachability"), ["run_id", "target"],
                  _processor(f"{STATE_ORDER}, up boolean", step),
                  "run_id string, target string, timestamp timestamp_ntz, row_no bigint, transition string")
