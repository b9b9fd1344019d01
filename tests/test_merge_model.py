"""The set-based merge equals a sequential model of the ingest rules."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from receiptflow.operators import merge as M

D0 = dt.date(2026, 1, 1)


def sequential(sightings, refunds, existing=()):
    """Plain restatement: messages in seq order; first sighting inserts,
    later ones fill NULL dates (enriched) or are duplicates; refunds flip the
    rows that exist at that point."""
    events = sorted([(s["seq"], s["pos"], "s", s) for s in sightings]
                    + [(r["seq"], 0, "r", r) for r in refunds], key=lambda e: (e[0], e[1]))
    rows = {("p", "s", e["order_id"] or "", e["name"] or ""): {
        "delivered_at": e["delivered_at"], "return_by": e["return_by"], "state": e["state"]} for e in existing}
    counts = {"added": 0, "enriched": 0, "duplicate_items": 0, "returned": 0}
    for _, _, kind, e in events:
        if kind == "r":
            for k, row in rows.items():
                if k[2] == e["order_id"] and row["state"] != "returned":
                    row["state"] = "returned"
                    counts["returned"] += 1
            continue
        k = ("p", "s", e["order_id"] or "", e["name"] or "")
        if k not in rows:
            rows[k] = {"delivered_at": e["delivered_at"], "return_by": e["return_by"], "state": "evaluate"}
            counts["added"] += 1
            continue
        row = rows[k]
        offered = [c for c in ("delivered_at", "return_by") if e[c]]
        if offered and any(row[c] is None for c in offered):
            for c in offered:
                row[c] = row[c] or e[c]
            counts["enriched"] += 1
        else:
            counts["duplicate_items"] += 1
    return rows, counts


sighting = st.fixed_dictionaries({
    "order_id": st.sampled_from(["A", "B", None, ""]),
    "name": st.sampled_from(["x", "y", None]),
    "delivered_at": st.one_of(st.none(), st.integers(0, 5).map(lambda d: D0 + dt.timedelta(d))),
    "return_by": st.one_of(st.none(), st.integers(0, 5).map(lambda d: D0 + dt.timedelta(d))),
})


stored = st.fixed_dictionaries({
    "order_id": st.sampled_from(["A", "B", None]), "name": st.sampled_from(["x", "y", "z"]),
    "delivered_at": st.one_of(st.none(), st.just(D0)), "return_by": st.one_of(st.none(), st.just(D0)),
    "state": st.sampled_from(["keep", "returned", "evaluate", None]),
})


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(sighting, min_size=1, max_size=12),
       st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["A", "B"])), max_size=3),
       st.lists(stored, max_size=4, unique_by=lambda e: (e["order_id"], e["name"])))
def test_merge_matches_sequential(spark, ss, rr, old):
    sightings = [dict(s, seq=i // 3, pos=i % 3 + 1, uid=f"u{i // 3}") for i, s in enumerate(ss)]
    # a refund with seq q is "later than" every message with seq < q
    refunds = [{"seq": q, "order_id": o} for q, o in rr]
    s_df = spark.createDataFrame(
        [(s["uid"], s["seq"], s["pos"], "p", "s", s["order_id"], s["name"], s["delivered_at"], s["return_by"])
         for s in sightings],
        "uid string, seq long, pos int, profile string, seller string, order_id string, name string, "
        "delivered_at date, return_by date")
    r_df = spark.createDataFrame([(f"r{i}", r["seq"], "p", r["order_id"], None) for i, r in enumerate(refunds)],
                                 "uid string, seq long, profile string, order_id string, name string")
    e_df = spark.createDataFrame(
        [(10 + i, "p", "s", e["order_id"], e["name"], e["delivered_at"], e["return_by"], e["state"], f"note {i}")
         for i, e in enumerate(old)],
        "id long, profile string, seller string, order_id string, name string, delivered_at date, return_by date, "
        "return_state string, note string")
    # model: the refund sits just before the messages that share its number
    model_refunds = [{"seq": r["seq"] - 0.5, "order_id": r["order_id"]} for r in refunds]
    rows, counts = sequential(sightings, model_refunds, old)
    got_counts = M.merge_counts(s_df, r_df, e_df).first().asDict()
    assert got_counts == counts
    m = M.merge_lifecycle(s_df, r_df, e_df, assign_ids=False).collect()
    got = {(r.k_profile, r.k_seller, r.k_order_id, r.k_name): (r.delivered_at, r.return_by, r.return_state)
           for r in m}
    want = {k: (v["delivered_at"], v["return_by"], v["state"]) for k, v in rows.items()}
    assert got == want
    assert sorted((r.id, r.note) for r in m if not r.added) == [(10 + i, f"note {i}") for i in range(len(old))]
