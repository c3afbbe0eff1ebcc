"""SQL for the rows of queries.py. Ancestors come from a recursive query here, from a fold there."""

from __future__ import annotations

from .operators.metrics import OUTCOMES

LENS = """
tx AS (
  SELECT o_orderkey AS trace_id, o_custkey % 7 AS sender, CAST(floor(o_totalprice) AS BIGINT) AS gas_used,
         CASE WHEN o_orderstatus = 'F' THEN 'Reverted' ELSE 'Success' END AS status
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
), numbered AS (
  SELECT *, l_orderkey AS trace_id, CAST(floor(l_quantity) AS BIGINT) AS qty, CAST(row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS call_id
  FROM lineitem
), c AS (
  SELECT trace_id, call_id, qty, l_suppkey, l_partkey, l_linenumber, l_returnflag,
         CASE WHEN call_id = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN call_id - 1
              ELSE CAST(floor((call_id - 1) / 2.0) AS INTEGER) END AS parent_id,
         CASE WHEN call_id = 0 OR l_partkey % 10 < 5 THEN 'Call' WHEN l_partkey % 10 = 5 THEN 'StaticCall'
              WHEN l_partkey % 10 = 6 THEN 'DelegateCall' WHEN l_partkey % 10 = 7 THEN 'CallCode'
              WHEN l_partkey % 10 = 8 THEN 'Create' ELSE 'Selfdestruct' END AS kind,
         l_suppkey % 4 AS to_n, l_partkey % 16 AS sel, l_linestatus = 'F' AS succeeded
  FROM numbered
), k AS (
  SELECT *, CASE kind WHEN 'Call' THEN 'External' WHEN 'DelegateCall' THEN 'Delegate' WHEN 'CallCode' THEN 'Delegate'
                      WHEN 'Selfdestruct' THEN 'SelfDestruct' ELSE kind END AS class,
         CASE WHEN l_suppkey % 2 = 1 AND kind <> 'StaticCall' THEN qty ELSE 0 END AS amount FROM c
), calls AS (
  SELECT k.*, p.class AS parent_class, tx.sender, tx.status, CASE WHEN k.call_id = 0 THEN tx.sender ELSE p.to_n END AS from_n
  FROM k JOIN tx USING (trace_id) LEFT JOIN k p ON p.trace_id = k.trace_id AND p.call_id = k.parent_id
), up(trace_id, call_id, above, depth) AS (
  SELECT trace_id, call_id, parent_id, 1 FROM c WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT up.trace_id, up.call_id, c.parent_id, up.depth + 1 FROM up JOIN c ON c.trace_id = up.trace_id AND c.call_id = up.above
  WHERE c.parent_id IS NOT NULL
), above AS (
  SELECT up.trace_id, up.call_id, bool_or(a.to_n = x.to_n) AS reentrant, bool_or(a.class = 'Delegate') AS under_delegate, max(depth) AS depth
  FROM up JOIN k a ON a.trace_id = up.trace_id AND a.call_id = up.above JOIN k x ON x.trace_id = up.trace_id AND x.call_id = up.call_id
  GROUP BY 1, 2
), ec AS (
  SELECT calls.*, coalesce(above.reentrant, FALSE) AS reentrant, coalesce(above.under_delegate, FALSE) AS under_delegate,
         CAST(coalesce(above.depth, 0) AS INTEGER) AS depth
  FROM calls LEFT JOIN above USING (trace_id, call_id)
), st AS (
  SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY call_id) - 1 AS INTEGER) AS id, call_id, kind, class,
         l_partkey % 3 AS slot, l_suppkey % 2 = 1 AS changed
  FROM k WHERE l_returnflag = 'R'
), lg AS (
  SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY call_id) - 1 AS INTEGER) AS id, call_id, to_n, qty,
         l_suppkey % 2 = 0 AS transfer, l_suppkey % 2 = 0 AND l_partkey % 3 = 1 AS decoded, l_suppkey % 7 AS src, l_linenumber % 7 AS dst
  FROM k WHERE l_returnflag = 'A'
), tt AS (
  SELECT lg.trace_id, CAST(row_number() OVER (PARTITION BY lg.trace_id ORDER BY lg.id) - 1 AS INTEGER) AS id, lg.id AS log_id, call_id, to_n AS token, src, dst, qty, sender
  FROM lg JOIN tx USING (trace_id) WHERE decoded
)"""


def _sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {LENS}{more}\n{body}"


def _facts(table: str, kind: str, where: str, id_: str = "id") -> str:
    return _sql(f"SELECT trace_id, '{kind}' AS fact_kind, {id_} AS fact_id, call_id AS ord, call_id FROM {table} WHERE {where}")


def _call(where: str) -> str:
    return _facts("ec", "Call", where, "call_id")


ORACLE_SQL = {
    "call_kind": _call("class = 'Delegate'"),
    "call_kind_internal": _call("FALSE"),
    "call_reentrant": _call("class = 'External' AND reentrant"),
    "call_value_flow_in": _call("class = 'External' AND to_n = sender"),
    "call_value_flow_out": _call("class = 'External' AND from_n = sender"),
    "call_min_value": _call("class = 'External' AND amount >= 25"),
    "call_selector": _call("class = 'External' AND sel = 3"),
    "call_selector_malformed": _call("FALSE"),
    "call_succeeded": _call("class = 'Create' AND succeeded"),
    "call_parent_kind": _call("class = 'SelfDestruct' AND parent_class = 'Delegate'"),
    "call_ancestor_kind": _call("class = 'SelfDestruct' AND under_delegate"),
    "storage_changed": _facts("st", "StorageChange", "changed"),
    "storage_unchanged": _facts("st", "StorageChange", "NOT changed"),
    "storage_slot": _facts("st", "StorageChange", "changed AND slot = 0"),
    "storage_call_kind": _facts("st", "StorageChange", "changed AND class = 'Delegate'"),
    "value_flow_minmax": _call("amount <> 0 AND from_n = sender AND amount BETWEEN 10 AND 40"),
    "token_transfer_direction": _facts("tt", "TokenTransfer", "dst = sender"),
    "token_transfer_token": _facts("tt", "TokenTransfer", "src = sender AND token = 2"),
    "transaction_status_gas": _sql(
        "SELECT trace_id, 'Call' AS fact_kind, 0 AS fact_id, -1 AS ord, 0 AS call_id FROM tx WHERE status = 'Success' AND gas_used >= 100000"
    ),
    "log_topic0": _facts("lg", "Log", "NOT transfer"),
    "log_decoded_true": _facts("lg", "Log", "transfer AND decoded"),
    "log_decoded_false": _facts("lg", "Log", "transfer AND NOT decoded"),
    "parent_join": _sql("SELECT trace_id, call_id, class AS kind_class, parent_class FROM calls"),
    "reentrancy": _sql("SELECT trace_id, call_id, reentrant FROM ec"),
    "depth": _sql("SELECT trace_id, call_id, depth FROM ec"),
    "storage_context": _sql(
        "SELECT trace_id, call_id, '0x' || lpad(lower(to_hex(ctx)), 40, '0') AS context FROM held",
        """, held(trace_id, call_id, ctx) AS (
  SELECT trace_id, call_id, to_n FROM c WHERE kind NOT IN ('DelegateCall', 'CallCode') OR parent_id IS NULL
  UNION ALL
  SELECT c.trace_id, c.call_id, held.ctx FROM held JOIN c ON c.trace_id = held.trace_id AND c.parent_id = held.call_id
  WHERE c.kind IN ('DelegateCall', 'CallCode')
)""",
    ),
    "transfer_decode": _sql(
        """SELECT trace_id, id, log_id, call_id, '0x' || lpad(lower(to_hex(token)), 40, '0') AS token, '0x' || lpad(lower(to_hex(src)), 40, '0') AS from_addr,
  '0x' || lpad(lower(to_hex(dst)), 40, '0') AS to_addr, lpad(lower(to_hex(qty)), 32, '0') AS amount_hex FROM tt"""
    ),
    "children_of": _sql("SELECT trace_id, call_id, parent_id FROM c WHERE parent_id = 1"),
    "value_flows": _sql(
        """SELECT trace_id, call_id, '0x' || lpad(lower(to_hex(from_n)), 40, '0') AS from_addr, '0x' || lpad(lower(to_hex(to_n)), 40, '0') AS to_addr,
  lpad(lower(to_hex(amount)), 32, '0') AS amount_hex FROM calls WHERE amount <> 0"""
    ),
    "net_value_extracted": _sql(
        """SELECT trace_id, '0x' || lpad(lower(to_hex(n)), 40, '0') AS address, CAST(sum(v) AS BIGINT) AS net FROM (
  SELECT trace_id, to_n AS n, amount AS v FROM calls WHERE amount <> 0 UNION ALL SELECT trace_id, from_n, -amount FROM calls WHERE amount <> 0
) GROUP BY 1, 2"""
    ),
    "arena_integrity": _sql(
        """SELECT trace_id, CASE WHEN trace_id % 5 = 3 AND n_calls > 2 THEN 'multiple-roots' WHEN trace_id % 5 = 1 AND n_st > 0 THEN 'dangling-storage-change'
  WHEN trace_id % 5 = 2 AND n_lg > 1 THEN 'duplicate-log-index' ELSE 'none' END AS error FROM n""",
        """, n AS (
  SELECT trace_id, (SELECT count(*) FROM c WHERE c.trace_id = tx.trace_id) AS n_calls, (SELECT count(*) FROM st WHERE st.trace_id = tx.trace_id) AS n_st,
         (SELECT count(*) FROM lg WHERE lg.trace_id = tx.trace_id) AS n_lg FROM tx
)""",
    ),
    "dangling_references": _sql("SELECT trace_id, id, call_id FROM st WHERE kind = 'StaticCall'"),
    "relations_round_trip": _sql("SELECT kind, count(*) AS n, count(*) FILTER (WHERE succeeded) AS n_succeeded FROM c GROUP BY kind"),
    "trace_summary": _sql(
        """SELECT trace_id, CAST((SELECT count(*) FROM c WHERE c.trace_id = tx.trace_id) AS INTEGER) AS call_count,
  CAST((SELECT count(*) FROM st WHERE st.trace_id = tx.trace_id) AS INTEGER) AS storage_change_count,
  CAST((SELECT count(*) FROM lg WHERE lg.trace_id = tx.trace_id) AS INTEGER) AS log_count,
  CAST((SELECT count(*) FROM tt WHERE tt.trace_id = tx.trace_id) AS INTEGER) AS token_transfer_count FROM tx"""
    ),
}

# ------------------------------------------------------------------ candidates: trace_id, place (order of the anchor), bindings, outcome

_FIRST_ST = "(SELECT id FROM st WHERE st.trace_id = a.trace_id AND changed {0} ORDER BY call_id, id LIMIT 1)"
_ANY_ST = "EXISTS (SELECT 1 FROM st WHERE st.trace_id = a.trace_id AND changed)"

#: pattern -> (anchor rows with `place` and `b`, the status, verified and required clauses, what the explanation adds, reasons)
CANDIDATES = {
    "unsafe_selfdestruct": "SELECT trace_id, call_id AS place, '0:Call:' || call_id AS b FROM ec a WHERE class = 'SelfDestruct' AND succeeded",
    "delegatecall_reachable_selfdestruct": "SELECT trace_id, call_id AS place, '0:Call:' || call_id AS b FROM ec a WHERE class = 'SelfDestruct' AND succeeded AND parent_class = 'Delegate'",
    "delegatecall_reachable_selfdestruct_transitive": "SELECT trace_id, call_id AS place, '0:Call:' || call_id AS b FROM ec a WHERE class = 'SelfDestruct' AND succeeded AND under_delegate",
    "delegatecall_storage_collision": "SELECT trace_id, id AS place, '0:StorageChange:' || id AS b FROM st a WHERE changed AND slot = 0 AND class = 'Delegate'",
    "spoofed_transfer_event": "SELECT trace_id, id AS place, '0:Log:' || id AS b FROM lg a WHERE transfer AND NOT decoded",
    "unchecked_external_call": "SELECT trace_id, call_id AS place, '0:Call:' || call_id || ';1:Call:0' AS b FROM ec a WHERE class = 'External' AND NOT succeeded AND status = 'Success'",
    "classic_reentrancy": f"""SELECT trace_id, place, '0:Call:' || place || ';1:StorageChange:' || s AS b FROM (
  SELECT trace_id, call_id AS place, {_FIRST_ST.format("AND call_id >= a.call_id")} AS s FROM ec a WHERE class = 'External' AND reentrant AND from_n = sender
) WHERE s IS NOT NULL""",
    "oracle_manipulation": f"""SELECT trace_id, place, '0:TokenTransfer:' || place || ';1:StorageChange:' || s AS b FROM (
  SELECT trace_id, id AS place, {_FIRST_ST.format("AND call_id >= a.call_id")} AS s FROM tt a WHERE dst = sender
) WHERE s IS NOT NULL""",
    "constraint_and": f"""SELECT trace_id, call_id AS place, '0:Call:' || call_id || ';1:StorageChange:' || {_FIRST_ST.format("")} AS b
  FROM ec a WHERE class = 'External' AND NOT succeeded AND {_ANY_ST}""",
    "constraint_or": """SELECT trace_id, call_id AS place, '0:Call:' || call_id
  || coalesce(';1:Log:' || (SELECT id FROM lg WHERE lg.trace_id = a.trace_id AND decoded ORDER BY id LIMIT 1), '') AS b FROM ec a WHERE class = 'SelfDestruct'""",
    "constraint_not": """SELECT trace_id, call_id AS place, '0:Call:' || call_id AS b FROM ec a
  WHERE class = 'External' AND NOT succeeded AND NOT EXISTS (SELECT 1 FROM k WHERE k.trace_id = a.trace_id AND k.class = 'Delegate')""",
    "global_negated": "SELECT trace_id, 0 AS place, '' AS b FROM tx a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.trace_id = a.trace_id AND k.class = 'SelfDestruct')",
    "sequence": """SELECT trace_id, place, '0:Call:' || place || ';1:StorageChange:' || id || ';2:Call:' || gone AS b FROM (
  SELECT s.*, (SELECT min(k.call_id) FROM k WHERE k.trace_id = s.trace_id AND k.class = 'SelfDestruct' AND k.call_id >= s.at) AS gone FROM (
    SELECT a.trace_id, a.call_id AS place, x.id, x.call_id AS at FROM ec a JOIN st x ON x.trace_id = a.trace_id AND x.changed AND x.call_id >= a.call_id
    WHERE a.class = 'Create' QUALIFY row_number() OVER (PARTITION BY a.trace_id, a.call_id ORDER BY x.call_id, x.id) = 1) s
) WHERE gone IS NOT NULL""",
    "same_call": """SELECT a.trace_id, a.call_id AS place, '0:Call:' || a.call_id || ';1:StorageChange:' || x.id AS b
  FROM ec a JOIN st x ON x.trace_id = a.trace_id AND x.call_id = a.call_id AND x.changed WHERE a.class = 'External' AND a.sel = 3""",
}

_PLACED = "SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY place) - 1 AS INTEGER) AS candidate_pos, b AS bindings FROM cand"
_IDS = {"sequence": "in_sequence", "same_call": "in_same_call"}
_VERSION = {"delegatecall_storage_collision": 2}
_CLAUSES = {"classic_reentrancy": 2, "oracle_manipulation": 2, "unchecked_external_call": 2, "constraint_and": 2, "constraint_or": 2, "sequence": 3, "same_call": 2, "proxy_upgrade_self_write": 2}
_NOTES = {
    "classic_reentrancy": " sequence ordering confirmed.", "oracle_manipulation": " sequence ordering could not be confirmed.",
    "sequence": " sequence ordering confirmed.", "same_call": " same_call correlation confirmed.", "proxy_upgrade_self_write": " same_call correlation confirmed.",
}
#: Where not all candidates are grounded: status, verified clauses, reasons.
_STATUS = {
    "oracle_manipulation": ("'abstain'", "0", "3"),
    "constraint_or": ("CASE WHEN b LIKE '%Log%' THEN 'grounded' ELSE 'abstain' END", "CASE WHEN b LIKE '%Log%' THEN 2 ELSE 1 END", "CASE WHEN b LIKE '%Log%' THEN 0 ELSE 1 END"),
}

# The example patterns, over traces whose selector 3 is the one that they look for.
CANDIDATES |= {
    "unauthorized_upgrade_to": """SELECT trace_id, call_id AS place, '0:Call:' || call_id AS b FROM ec a WHERE class = 'External' AND sel = 3
  AND NOT EXISTS (SELECT 1 FROM calls x WHERE x.trace_id = a.trace_id AND x.class = 'External' AND x.sel = 3 AND x.from_n = x.sender)""",
    "proxy_upgrade_self_write": """SELECT a.trace_id, a.call_id AS place, '0:Call:' || a.call_id || ';1:StorageChange:' || x.id AS b
  FROM ec a JOIN st x ON x.trace_id = a.trace_id AND x.call_id = a.call_id AND x.changed AND x.slot = 0 WHERE a.class = 'External' AND a.sel = 3""",
}

for _name, _rows in CANDIDATES.items():
    _of = f", cand AS ({_rows})"
    _key = f"candidates_{_name}" if not _name.startswith(("constraint_", "global_", "sequence", "same_call")) else _name
    ORACLE_SQL[_key] = _sql(_PLACED, _of)
    _total = _CLAUSES.get(_name, 1)
    _status, _verified, _reasons = _STATUS.get(_name, ("'grounded'", str(_total), "0"))
    ORACLE_SQL[f"grounding_{_name}"] = _sql(
        f"""SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY place) - 1 AS INTEGER) AS candidate_pos, status, {_total} AS required_total,
  verified AS required_verified, 'pattern `{_IDS.get(_name, _name)}` v{_VERSION.get(_name, 1)}: ' || status || ' (' || verified || '/{_total} required evidence clauses verified).{_NOTES.get(_name, "")}' AS explanation,
  n_reasons FROM (SELECT *, {_status} AS status, {_verified} AS verified, {_reasons} AS n_reasons FROM cand)""",
        _of,
    )

_HASHED = ("unsafe_selfdestruct", "classic_reentrancy")
ORACLE_SQL["candidate_ids"] = _sql(
    """SELECT trace_id, id AS pattern_id, candidate_pos, lpad(lower(to_hex(CAST(
  list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(bytes, lambda x: CAST(x AS HUGEINT))), lambda h, x: xor(h, x) * 1099511628211 % 18446744073709551616)
AS UBIGINT))), 16, '0') AS candidate_id FROM m""",
    f""", cand AS ({" UNION ALL ".join(f"SELECT '{p}' AS id, * FROM ({CANDIDATES[p]}) t{i}" for i, p in enumerate(_HASHED))}), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY id, trace_id ORDER BY place) - 1 AS INTEGER) AS candidate_pos FROM cand
), m AS (
  SELECT trace_id, id, candidate_pos, list_concat(list_concat(list_transform(string_split(id, ''), lambda x: ascii(x)), [255, 1, 0, 0, 0, 0, 0, 0, 0]),
    flatten(list_transform(string_split(b, ';'), lambda p: list_concat(list_concat([CAST(split_part(p, ':', 1) AS INTEGER), 0, 0, 0, 0, 0, 0, 0],
      list_transform(string_split(split_part(p, ':', 2) || '(' || split_part(p, ':', 2) || 'Id(' || split_part(p, ':', 3) || '))', ''), lambda x: ascii(x))), [255])))) AS bytes
  FROM placed
)""",
)

ORACLE_SQL["net_value_wide"] = _sql(
    """SELECT trace_id, '0x' || lpad(lower(to_hex(n)), 40, '0') AS address,
  CASE WHEN abs(sum(v)) < 64 THEN CAST(CAST(sum(v) AS HUGEINT) * 2658455991569831745807614120560689152 AS VARCHAR) WHEN sum(v) = -64 THEN '-170141183460469231731687303715884105728' ELSE 'none' END AS net_digits FROM (
  SELECT trace_id, to_n AS n, amount AS v FROM calls WHERE amount <> 0 UNION ALL SELECT trace_id, from_n, -amount FROM calls WHERE amount <> 0
) GROUP BY trace_id, n"""
)

ORACLE_SQL["fact_lookup"] = _sql("SELECT trace_id, id, call_id, kind FROM st WHERE id = trace_id % 3")

_DOCUMENTS = """, d AS (
  SELECT trace_id, (SELECT count(*) FROM c WHERE c.trace_id = tx.trace_id) AS n_calls, (SELECT count(*) FROM st WHERE st.trace_id = tx.trace_id) AS n_changes,
         (SELECT count(*) FROM lg WHERE lg.trace_id = tx.trace_id) AS n_logs, (SELECT count(*) FROM tt WHERE tt.trace_id = tx.trace_id) AS n_transfers,
         (SELECT count(*) FROM c WHERE c.trace_id = tx.trace_id AND c.kind = 'StaticCall') AS n_static FROM tx
), e AS (
  SELECT *, CASE WHEN trace_id % 16 IN (1, 8) THEN 'MalformedInput' WHEN trace_id % 16 = 2 THEN 'UnsupportedFeature'
    WHEN trace_id % 16 = 3 AND n_logs > 1 THEN 'DuplicateLogIndex' WHEN trace_id % 16 = 4 AND n_changes > 0 THEN 'InvalidStorageOwnership'
    WHEN trace_id % 16 IN (5, 7) THEN 'MalformedField' WHEN trace_id % 16 = 6 AND n_static > 0 THEN 'ArenaConstruction' ELSE 'none' END AS error_kind FROM d
)"""
ORACLE_SQL["ingest_outcomes"] = _sql(
    "SELECT trace_id, error_kind, " + ", ".join(f"CAST(CASE WHEN error_kind = 'none' THEN {n} ELSE -1 END AS INTEGER) AS {n}" for n in ("n_calls", "n_changes", "n_logs", "n_transfers")) + " FROM e",
    _DOCUMENTS,
)
ORACLE_SQL["ingest_calls"] = _sql(
    """SELECT k.trace_id, k.call_id, CASE WHEN k.call_id > 0 THEN 0 ELSE -1 END AS parent_id, k.kind, CASE WHEN k.call_id > 0 THEN 1 ELSE 0 END AS depth, k.succeeded,
  '0x' || lpad(lower(to_hex(k.sel)), 8, '0') AS selector, lpad(lower(to_hex(k.amount)), 32, '0') AS value_hex,
  '0x' || lpad(lower(to_hex(CASE WHEN k.kind IN ('DelegateCall', 'CallCode') THEN r.to_n ELSE k.to_n END)), 40, '0') AS context
FROM k JOIN e USING (trace_id) JOIN c r ON r.trace_id = k.trace_id AND r.call_id = 0 WHERE e.error_kind = 'none'""",
    _DOCUMENTS,
)
_TREE = """, tree(trace_id, call_id, path, depth, ctx) AS (
  SELECT trace_id, call_id, [call_id], 0, to_n FROM k WHERE parent_id IS NULL
  UNION ALL
  SELECT k.trace_id, k.call_id, list_append(tree.path, k.call_id), tree.depth + 1,
         CASE WHEN k.kind IN ('DelegateCall', 'CallCode') THEN tree.ctx ELSE k.to_n END
  FROM tree JOIN k ON k.trace_id = tree.trace_id AND k.parent_id = tree.call_id
), visited AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS INTEGER) AS place FROM tree
)"""
ORACLE_SQL["ingest_nested_calls"] = _sql(
    """SELECT v.trace_id, v.place AS call_id, k.kind, v.depth, '0x' || lpad(lower(to_hex(k.sel)), 8, '0') AS selector, lpad(lower(to_hex(k.amount)), 32, '0') AS value_hex,
  '0x' || lpad(lower(to_hex(v.ctx)), 40, '0') AS context, coalesce(p.place, -1) AS parent_id,
  CAST((SELECT count(*) FROM st WHERE st.trace_id = v.trace_id AND st.call_id = v.call_id) AS INTEGER) AS n_changes
FROM visited v JOIN k USING (trace_id, call_id) LEFT JOIN visited p ON p.trace_id = v.trace_id AND p.call_id = k.parent_id""",
    _TREE,
)
ORACLE_SQL["ingest_call_tracer"] = _sql(
    """SELECT '0x' || lpad(lower(to_hex(o.o_orderkey)), 64, '0') AS trace_id, e.error_kind,
  CASE WHEN e.error_kind <> 'none' THEN -1 WHEN o.o_orderkey % 5 = 0 THEN 0 ELSE o.o_custkey END AS nonce,
  CASE WHEN e.error_kind <> 'none' THEN -1 WHEN o.o_orderkey % 5 = 0 THEN 7 ELSE CAST(floor(o.o_totalprice) AS BIGINT) END AS block_number,
  CASE WHEN e.error_kind <> 'none' THEN -1 WHEN o.o_orderkey % 5 = 0 THEN 0 ELSE CAST(epoch(o.o_orderdate) AS BIGINT) END AS block_ts,
  CAST(CASE WHEN e.error_kind <> 'none' THEN -1 WHEN o.o_orderkey % 5 = 0 THEN 1 ELSE 5 END AS BIGINT) AS chain_id,
  CASE WHEN e.error_kind <> 'none' THEN 'none' WHEN r.succeeded THEN 'Success' ELSE 'Reverted' END AS status,
  CASE WHEN e.error_kind <> 'none' THEN '' ELSE e.calls END AS calls
FROM orders o JOIN k r ON r.trace_id = o.o_orderkey AND r.call_id = 0 JOIN e ON e.trace_id = o.o_orderkey""",
    _TREE
    + """, e AS (
  SELECT v.trace_id, CASE WHEN v.trace_id % 7 = 3 THEN 'MalformedInput' WHEN v.trace_id % 11 = 3 THEN 'UnsupportedFeature' ELSE 'none' END AS error_kind,
         string_agg(v.depth || ':' || lower(k.kind) || ':' || k.succeeded, ';' ORDER BY v.place) AS calls
  FROM visited v JOIN k USING (trace_id, call_id) GROUP BY v.trace_id
)""",
)
ORACLE_SQL["broken_relations"] = _sql(
    """SELECT trace_id, error, CAST(CASE WHEN error = 'none' THEN n ELSE -1 END AS INTEGER) AS n_reentrant FROM (
  SELECT trace_id, count(*) FILTER (reentrant) AS n, CASE WHEN trace_id % 6 IN (1, 3) AND count(*) > 1 OR trace_id % 6 = 2 AND count(*) > 1 THEN 'forward-parent' ELSE 'none' END AS error
  FROM ec GROUP BY trace_id)"""
)
ORACLE_SQL["evidence_chain"] = _sql(
    """SELECT trace_id, candidate_pos, clause, name, outcome, CASE WHEN outcome = 'Verified' THEN fact END AS fact, category FROM (
  SELECT p.*, q.clause, q.name, CASE WHEN q.clause = 0 OR b LIKE '%Log%' THEN 'Verified' ELSE 'Unavailable' END AS outcome,
         CASE WHEN q.clause = 0 THEN split_part(split_part(b, ';', 1), ':', 3) ELSE split_part(split_part(b, ';', 2), ':', 3) END AS fact,
         CASE WHEN q.clause = 1 AND b NOT LIKE '%Log%' THEN 'missing-fact' END AS category
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY place) - 1 AS INTEGER) AS candidate_pos FROM cand) p
  CROSS JOIN (VALUES (0, 'gone'), (1, 'sent')) q(clause, name))""",
    f", cand AS ({CANDIDATES['constraint_or']})",
)

ORACLE_SQL["grounding_fabricated"] = _sql(
    """SELECT trace_id, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.trace_id = tx.trace_id AND class = 'SelfDestruct' AND succeeded) THEN 'ungrounded' ELSE 'abstain' END AS status,
  0 AS required_verified FROM tx"""
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x + "'" for x in row) + ")" for row in rows)


# The codes of the public registries, stated here on their own.
_CODES = """SELECT family, string_agg(code, ',' ORDER BY code) AS codes, bool_or(code LIKE 'SCWE-%') AS scwe, bool_or(code LIKE 'SWC-%') AS swc FROM (VALUES
  ('Reentrancy', 'SCWE-046'), ('OracleManipulation', 'SCWE-028'), ('UnauthorizedUpgrade', 'SCWE-005'), ('UncheckedExternalCall', 'SCWE-048'),
  ('DelegatecallStorageCollision', 'SCWE-150'), ('UnsafeSelfdestruct', 'SCWE-050'), ('DelegatecallReachableSelfdestruct', 'SCWE-038'), ('SpoofedTransferEvent', 'SCWE-063'),
  ('Reentrancy', 'SWC-107'), ('UncheckedExternalCall', 'SWC-104'), ('DelegatecallStorageCollision', 'SWC-112'), ('UnsafeSelfdestruct', 'SWC-106'),
  ('DelegatecallReachableSelfdestruct', 'SWC-106')) s(family, code) GROUP BY family"""
_FAMILIES = {
    "classic_reentrancy": "Reentrancy", "delegatecall_reachable_selfdestruct": "DelegatecallReachableSelfdestruct",
    "delegatecall_reachable_selfdestruct_transitive": "DelegatecallReachableSelfdestruct", "delegatecall_storage_collision": "DelegatecallStorageCollision",
    "oracle_manipulation": "OracleManipulation", "spoofed_transfer_event": "SpoofedTransferEvent", "unchecked_external_call": "UncheckedExternalCall",
    "unsafe_selfdestruct": "UnsafeSelfdestruct",
}

ORACLE_SQL["taxonomy_join"] = f"""WITH e AS ({_CODES}), q AS (
  SELECT CASE o_orderkey % 11 WHEN 0 THEN 'Reentrancy' WHEN 1 THEN 'OracleManipulation' WHEN 2 THEN 'UnauthorizedUpgrade' WHEN 3 THEN 'UncheckedExternalCall'
    WHEN 4 THEN 'DelegatecallStorageCollision' WHEN 5 THEN 'UnsafeSelfdestruct' WHEN 6 THEN 'DelegatecallReachableSelfdestruct' WHEN 7 THEN 'SpoofedTransferEvent'
    WHEN 8 THEN 'UnknownFamily' WHEN 9 THEN 'reentrancy' ELSE '' END AS family, o_orderstatus FROM orders
)
SELECT q.family AS pattern_family, o_orderstatus AS status, coalesce(codes, '') AS codes,
  CASE WHEN codes IS NULL THEN 'SCWE,SWC' WHEN NOT swc THEN 'SWC' WHEN NOT scwe THEN 'SCWE' ELSE '' END AS unmapped, count(*) AS n
FROM q LEFT JOIN e ON e.family = q.family GROUP BY ALL"""
ORACLE_SQL["flagship"] = _sql(
    f"""SELECT f.id AS pattern_id, CASE WHEN f.id = 'oracle_manipulation' THEN 'abstain' ELSE 'grounded' END AS status, count(*) AS n, any_value(e.codes) AS codes
FROM found JOIN (VALUES {_values(_FAMILIES.items())}) f(id, family) ON f.id = found.id JOIN e ON e.family = f.family GROUP BY f.id""",
    ", e AS (" + _CODES + "), found AS (" + " UNION ALL ".join(f"SELECT '{p}' AS id, trace_id FROM ({CANDIDATES[p]}) t{i}" for i, p in enumerate(_FAMILIES)) + ")",
)

# ------------------------------------------------------------------ metrics

_SCORED = ("unsafe_selfdestruct", "delegatecall_reachable_selfdestruct", "unchecked_external_call", "oracle_manipulation")
_RESULTS = f""", found AS ({" UNION ALL ".join(f"SELECT {i} AS pos, trace_id FROM ({CANDIDATES[p]}) t{i}" for i, p in enumerate(_SCORED))}),
pats(pos, pattern_id, family) AS (VALUES {", ".join(f"({i}, '{p}', '{_FAMILIES[p]}')" for i, p in enumerate(_SCORED))}),
r AS (
  SELECT tx.trace_id AS case_id, pats.pattern_id, pats.family, coalesce(n.n, 0) AS candidates,
         CASE WHEN n.n IS NULL THEN 'no-match' WHEN pats.pos = 3 THEN 'abstain' ELSE 'grounded' END AS actual,
         CASE (tx.trace_id + pats.pos) % 5 {" ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OUTCOMES))} END AS expected
  FROM tx CROSS JOIN pats LEFT JOIN (SELECT pos, trace_id, count(*) AS n FROM found GROUP BY 1, 2) n ON n.pos = pats.pos AND n.trace_id = tx.trace_id
), s AS (SELECT *, expected = actual AS hit FROM r WHERE expected IS NOT NULL)"""
_DENSE = ", ".join(f"count(*) FILTER (WHERE actual = '{o}') AS {o.replace('-', '_')}" for o in OUTCOMES)
ORACLE_SQL |= {
    "outcome_strongest": _sql("SELECT case_id, pattern_id, candidates, actual FROM r", _RESULTS),
    "confusion_matrix": _sql("SELECT expected, actual, count(*) AS n FROM s GROUP BY 1, 2", _RESULTS),
    "confusion_matrix_dense": _sql(
        f"SELECT o.expected, {_DENSE} FROM (VALUES {_values([(o,) for o in OUTCOMES])}) o(expected) LEFT JOIN s ON s.expected = o.expected GROUP BY o.expected", _RESULTS
    ),
    "precision_recall_f1": _sql(
        """SELECT tp, fp, fn, tn, total, correct, round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 9) AS f1,
  round(CAST(correct AS DOUBLE) / total, 9) AS accuracy FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS q FROM (
  SELECT count(*) FILTER (WHERE expected = 'grounded' AND actual = 'grounded') AS tp, count(*) FILTER (WHERE expected <> 'grounded' AND actual = 'grounded') AS fp,
         count(*) FILTER (WHERE expected = 'grounded' AND actual <> 'grounded') AS fn, count(*) FILTER (WHERE expected <> 'grounded' AND actual <> 'grounded') AS tn,
         count(*) AS total, count(*) FILTER (WHERE hit) AS correct FROM s))""",
        _RESULTS,
    ),
    "per_pattern": _sql(
        """SELECT pattern_id, count(*) AS runs, count(*) FILTER (WHERE expected IS NULL OR expected = actual) AS passed, CAST(sum(candidates) AS BIGINT) AS candidates,
  round(CAST(count(*) FILTER (WHERE expected = actual) AS DOUBLE) / count(expected), 9) AS accuracy FROM r GROUP BY pattern_id""",
        _RESULTS,
    ),
    "per_family": _sql(
        """SELECT family, count(*) AS runs, count(*) FILTER (WHERE hit) AS passed, round(CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*), 9) AS accuracy
FROM s WHERE candidates > 0 GROUP BY family""",
        _RESULTS,
    ),
    "failures": _sql("SELECT case_id, pattern_id, expected, actual FROM s WHERE NOT hit", _RESULTS),
    "case_passed": _sql("SELECT case_id, bool_and(coalesce(expected = actual, TRUE)) AS passed, count(expected) AS n_scored FROM r GROUP BY case_id", _RESULTS),
}
