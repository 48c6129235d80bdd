"""Conversations rebuilt from message, call and result rows.

Rows arrive late, twice and interleaved, and the senders' clocks differ. The steps:

1. *Events.* Rows that differ in nothing but their arrival count once; roles lose outer
   blanks and case. A message, a call and a result is an event of its sender.
2. *Clock offsets.* A reply cannot be sent before what it answers: of two messages in a row
   of different senders the later one's time, less its sender's offset, is no less than the
   earlier one's, and so for a call and its result. The senders' offsets against the
   assistant's clock and one mean delay are the least-squares solution of the gaps, under
   these inequalities. A session whose inequalities no offsets satisfy (the senders' shortest
   gaps there and back sum up to less than nothing) has ``feasible`` false. Only counts, sums
   and minima by pair of senders (two dozen at most per session) are gathered.
3. *Merge.* Times are corrected. Events with an index stand at it; messages without one are
   merged in by corrected time, behind the last index whose messages are not later.
4. *Constraints.* A session is infeasible where its merged order breaks them: an index missing
   or held twice with different contents, a call without result, a result without or before
   its call, a last user message without reply. :func:`reasons` lists these;
   :func:`conversations` leaves such sessions out, and where asked those with infeasible clocks too.

Nothing gathers a session's texts into one task: a turn is a row.

Defined results: null session ids are ignored; a null role or text compares as ''; a text
is blank if null or of spaces, tabs and line breaks only; a session without any rows is
empty; calls with a null id are unanswered, results with a null id orphans; a message
without index makes no gap and no conflict; one without index and time comes last; with one
sender or without two gaps the offsets are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds by which a corrected reply may still precede what it answers.
TOLERANCE = 1.0
SENDERS = ("assistant", "user", "tool", "system")
MESSAGE, CALL, RESULT = 0, 1, 2


def clean_role(role: Column) -> Column:
    return F.lower(F.trim(F.coalesce(role, F.lit(""))))


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"\A[ \t\r\n]*\z")


def _time(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def events(messages: DataFrame, calls: DataFrame, results: DataFrame, keep_text: bool = False) -> DataFrame:
    """(session_id, message_index, what, role, digest, blank, call_id, at[, text]): repeated rows once, at in seconds."""
    known = F.col("session_id").isNotNull()
    text = F.coalesce("text", F.lit(""))
    m = messages.filter(known).select("session_id", "message_index", clean_role(F.col("role")).alias("role"), F.md5(text).alias("digest"), is_blank(F.col("text")).alias("blank"), _time(messages, "sent_at").alias("at"), *([text.alias("text")] if keep_text else []))
    kept = [F.first("text").alias("text")] if keep_text else []
    m = m.groupBy("session_id", "message_index", "role", "digest").agg(F.first("blank").alias("blank"), F.min("at").alias("at"), *kept).withColumns({"what": F.lit(MESSAGE), "call_id": F.lit(None).cast("string")})
    out = m
    for df, what, sender, time in ((calls, CALL, "assistant", "called_at"), (results, RESULT, "tool", "returned_at")):
        e = df.filter(known).groupBy("session_id", "message_index", "call_id").agg(F.min(_time(df, time)).alias("at"))
        out = out.unionByName(e.withColumns({"what": F.lit(what), "role": F.lit(sender)}), allowMissingColumns=True)
    return out


def _constraints(ev: DataFrame) -> DataFrame:
    """(session_id, before, sender, gap): an event of ``sender`` comes ``gap`` seconds after the one of ``before`` that it must follow."""
    w = W.partitionBy("session_id").orderBy("message_index", "at", "role", "digest")
    told = ev.filter((F.col("what") == MESSAGE) & F.col("role").isin(*SENDERS) & F.col("at").isNotNull() & F.col("message_index").isNotNull())
    told = told.select("session_id", F.lag("role").over(w).alias("before"), F.col("role").alias("sender"), (F.col("at") - F.lag("at").over(w)).alias("gap")).filter("before <> sender")
    acts = ev.filter((F.col("what") != MESSAGE) & F.col("call_id").isNotNull() & F.col("at").isNotNull()).groupBy("session_id", "call_id").agg(F.min(F.when(F.col("what") == CALL, F.col("at"))).alias("c"), F.min(F.when(F.col("what") == RESULT, F.col("at"))).alias("r"))
    acts = acts.filter("c is not null and r is not null").select("session_id", F.lit("assistant").alias("before"), F.lit("tool").alias("sender"), (F.col("r") - F.col("c")).alias("gap"))
    return told.unionByName(acts)


def solve(gaps: list[tuple[str, str, int, float, float]]) -> tuple[dict[str, float], float, bool]:
    """(offset of each sender, delay, feasible) from (before, sender, number, mean and shortest gap).

    Least squares of gap = offset(sender) - offset(before) + delay, under offset(sender) -
    offset(before) <= shortest gap where that can be; else without.
    """
    present = sorted({g[0] for g in gaps} | {g[1] for g in gaps}, key=SENDERS.index)
    n = len(present)
    at = {who: i for i, who in enumerate(present)}
    a, b, bound, most = np.zeros((len(gaps), n)), np.zeros(len(gaps)), np.zeros((len(gaps), n)), np.zeros(len(gaps))
    path = np.full((n, n), np.inf)
    for i, (before, sender, count, mean, shortest) in enumerate(sorted(gaps)):
        k = np.sqrt(count)
        for row, scale in ((a[i], k), (bound[i], 1.0)):
            row[at[sender]] += scale
            row[at[before]] -= scale
        a[i, 0] = k  # column 0 is the delay: the first sender's clock is the one measured against
        bound[i, 0] = 0.0
        b[i], most[i] = mean * k, shortest
        path[at[before], at[sender]] = shortest
    for k in range(n):  # shortest ways between senders: a way back to itself below 0 is a contradiction
        path = np.minimum(path, path[:, k : k + 1] + path[k : k + 1, :])
    feasible = bool((np.diag(path) >= -TOLERANCE).all())
    if len(gaps) < 2:
        return dict.fromkeys(present, 0.0), 0.0, feasible
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    if feasible and (bound @ x > most + 1e-9).any():
        # Hildreth's method: raise the price of each broken inequality in turn until none is
        q = np.linalg.pinv(a.T @ a + 1e-9 * np.eye(n))
        price = np.zeros(len(gaps))
        slope = np.einsum("ij,jk,ik->i", bound, q, bound)
        for _ in range(500):
            worst = 0.0
            for i in range(len(gaps)):
                if slope[i] <= 1e-12:
                    continue
                step = max(-price[i], (bound[i] @ x - most[i]) / slope[i])
                price[i] += step
                x = x - q @ bound[i] * step
                worst = max(worst, abs(step) * slope[i])
            if worst < 1e-6:
                break
    return {who: float(x[i]) if i else 0.0 for who, i in at.items()}, float(x[0]), feasible


def clock_offsets(ev: DataFrame) -> DataFrame:
    """(session_id, sender, offset_s, delay_s, n_gaps, feasible): seconds a sender's clock is ahead of the assistant's."""
    sums = _constraints(ev).groupBy("session_id", "before", "sender").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.min("gap").alias("shortest"))
    lists = sums.groupBy("session_id").agg(F.collect_list(F.struct("before", "sender", "n", "mean", "shortest")).alias("gaps"))
    schema = {"session_id": pa.string(), "sender": pa.string(), "offset_s": pa.float64(), "delay_s": pa.float64(), "n_gaps": pa.int64(), "feasible": pa.bool_()}

    def run(batches):
        for batch in batches:
            rows = []
            for session, gaps in zip(batch.column("session_id").to_pylist(), batch.column("gaps").to_pylist()):
                offsets, delay, feasible = solve([tuple(g.values()) for g in gaps])
                rows += [(session, who, v, delay, sum(g["n"] for g in gaps), feasible) for who, v in offsets.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], names=list(schema))

    return lists.mapInArrow(run, "session_id string, sender string, offset_s double, delay_s double, n_gaps long, feasible boolean")


def timeline(ev: DataFrame) -> DataFrame:
    """The messages and calls with corrected times and their places: ``slot`` and, for messages without index, ``late``.

    slot is the index or, without one, that of the last indexed event whose corrected time is not later.
    """
    offsets = clock_offsets(ev).select("session_id", F.col("sender").alias("role"), "offset_s", "feasible")
    rows = ev.filter(F.col("what") != RESULT).join(offsets, ["session_id", "role"], "left")
    rows = rows.withColumn("corrected", F.col("at") - F.coalesce("offset_s", F.lit(0.0)))
    # the events before in time, and of those of one time the ones with an index
    before = W.partitionBy("session_id").orderBy(F.asc_nulls_last("corrected"), F.asc_nulls_last("message_index")).rowsBetween(W.unboundedPreceding, W.currentRow)
    slot = F.coalesce("message_index", F.max("message_index").over(before), F.lit(-1))
    late = F.when(F.col("message_index").isNotNull(), F.lit(-1)).otherwise(F.coalesce((F.col("corrected") * 1e6).cast("long"), F.lit((1 << 62))))
    return rows.withColumn("slot", slot).withColumn("late", late)


def reasons(sessions: DataFrame, messages: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, reason): one row per session and reason why it is left out, from the merged order."""
    ev = events(messages, calls, results)
    line = timeline(ev)
    said, indexed = F.col("what") == MESSAGE, F.col("message_index").isNotNull()
    has = lambda role: said & (F.col("role") == role)
    place = F.struct("slot", "late")
    answers = has("assistant") & ~F.col("blank")
    facts = line.groupBy("session_id", "slot").agg(
        F.count_if(said & indexed).alias("n"),
        F.bool_or(has("")).alias("no_role"),
        F.bool_or(said & ~F.col("blank")).alias("filled"),
        F.max(F.when(has("user") & ~F.col("blank"), place)).alias("asked"),
        F.max(F.when(answers, place)).alias("answered"),
        F.max(F.when(has("assistant") & indexed, place)).alias("assistant"),
        F.bool_or(F.col("what") == CALL).alias("called"),
    )
    here = F.when(F.col("n") > 0, F.col("slot"))
    per = facts.groupBy("session_id").agg(
        F.bool_or("filled").alias("filled"),
        ((F.count(here) != F.max(here) + 1) | (F.min(here) != 0)).alias("gap"),
        F.bool_or("no_role").alias("no_role"),
        F.bool_or(F.col("n") > 1).alias("conflict"),
        F.max("asked").alias("last_asked"),
        F.max(F.greatest("answered", F.when(F.col("called"), F.col("assistant")))).alias("last_answer"),
    )
    acts = ev.filter(F.col("what") != MESSAGE).groupBy("session_id", "call_id").agg(*[F.min(F.when(F.col("what") == k, F.struct("message_index"))).alias(v) for k, v in ((CALL, "call"), (RESULT, "result"))])
    lone = lambda x, y: F.col(x).isNotNull() & (F.col(y).isNull() | F.col("call_id").isNull())
    pairs = acts.groupBy("session_id").agg(
        F.bool_or(lone("call", "result")).alias("unanswered_call"),
        F.bool_or(lone("result", "call")).alias("orphan_result"),
        F.bool_or(F.col("call_id").isNotNull() & (F.col("result.message_index") <= F.col("call.message_index"))).alias("result_before_call"),
        F.lit(True).alias("acts"),
    )
    known = sessions.filter(F.col("session_id").isNotNull()).select("session_id").distinct()
    rows = known.join(per, "session_id", "left").join(pairs, "session_id", "left")
    true = lambda c: F.coalesce(c, F.lit(False))
    empty = ~true(F.col("filled")) & ~true(F.col("acts"))
    no_reply = F.col("last_asked").isNotNull() & ~true(F.col("last_answer") > F.col("last_asked"))
    names = ("gap", "no_role", "conflict", "unanswered_call", "orphan_result", "result_before_call")
    found = F.filter(F.array(*[F.when(true(F.col(n)), F.lit(n)) for n in names], F.when(no_reply, F.lit("no_reply"))), lambda x: x.isNotNull())
    return rows.select("session_id", F.explode(F.when(empty, F.array(F.lit("empty"))).otherwise(found)).alias("reason"))


def _kept(sessions: DataFrame, messages: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    left_out = reasons(sessions, messages, calls, results).select("session_id").distinct()
    return sessions.filter(F.col("session_id").isNotNull()).select("session_id").distinct().join(left_out, "session_id", "left_anti")


def conversations(sessions: DataFrame, messages: DataFrame, calls: DataFrame, results: DataFrame, clocks_must_agree: bool = False) -> DataFrame:
    """Turns of all sessions without a reason to leave them out, in order.

    (session_id, turn, message_index, role, text, sent_at, corrected_at, early): early marks a
    reply that even the corrected clocks put before what it answers. With ``clocks_must_agree``
    sessions whose reply-before constraints no clock offsets satisfy are left out too.
    """
    kept = _kept(sessions, messages, calls, results)
    ev = events(messages, calls, results, keep_text=True).join(kept, "session_id", "left_semi")
    line = timeline(ev).filter(F.col("what") == MESSAGE)
    if clocks_must_agree:
        line = line.withColumn("agrees", F.coalesce(F.bool_and("feasible").over(W.partitionBy("session_id")), F.lit(True))).filter("agrees")
    w = W.partitionBy("session_id").orderBy("slot", "late", "corrected", "role", "digest")
    early = (F.lag("role").over(w) != F.col("role")) & (F.col("corrected") < F.lag("corrected").over(w) - TOLERANCE)
    stamp = lambda c: F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long"))
    return line.select("session_id", F.row_number().over(w).alias("turn"), "message_index", "role", "text", stamp("at").alias("sent_at"), stamp("corrected").alias("corrected_at"), F.coalesce(early, F.lit(False)).alias("early"))


def acts(sessions: DataFrame, messages: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, message_index, pos, call_id, tool, input_json, result_text, is_error): each call of a kept session with its result.

    Of several results of an id the first by index, place and id counts.
    """
    kept = _kept(sessions, messages, calls, results)
    once = results.filter(F.col("session_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("session_id", "call_id").agg(F.min_by(F.struct(F.col("text").alias("result_text"), "is_error"), F.struct("message_index", "pos", "result_id")).alias("r"))
    call = calls.filter(F.col("session_id").isNotNull()).groupBy("session_id", "message_index", "pos", "call_id").agg(F.min(F.struct("tool", "input_json")).alias("c"))
    return call.join(kept, "session_id", "left_semi").join(once, ["session_id", "call_id"], "left").select("session_id", "message_index", "pos", "call_id", "c.tool", "c.input_json", "r.result_text", "r.is_error")
