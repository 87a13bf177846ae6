"""Hash-chained audit logs, event taxonomy and run states.

An event has the columns run_id, line_no, ts_utc, event_type, vault_id, actor, details (JSON text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsons import canonical, missing_keys

ZERO = "0" * 64
#: Legal changes of a run's state; any state may become CANCELLED.
TRANSITIONS = {"CREATED": ("INGESTING", "READY"), "READY": ("EXECUTING", "EVALUATING"), "EXECUTING": ("EVALUATING",), "EVALUATING": ("EXPORTING", "FAILED"), "EXPORTING": ("COMPLETED", "FAILED")}
#: The detail keys that an event of a type must have.
REQUIRED = {
    "RUN_CREATED": ("pack_id", "pack_version", "policy_pack_id", "policy_pack_version", "determinism_enabled"),
    "RUN_STATE_CHANGED": ("from_state", "to_state", "reason"),
    "POLICY_APPLIED": ("policy_mode", "rules_enabled", "export_requirements"),
    "NETWORK_MODE_SET": ("network_mode", "proof_level", "ui_remote_fetch_disabled"),
    "ALLOWLIST_UPDATED": ("allowlist_hash_sha256", "allowlist_count"),
    "ARTIFACT_INGEST_STARTED": ("source_type", "source_ref"),
    "ARTIFACT_INGESTED": ("artifact_id", "artifact_sha256", "content_type", "size_bytes", "origin_path", "ingest_transformations"),
    "ARTIFACT_INGEST_COMPLETED": ("artifact_count",),
    "EVAL_STARTED": ("registry_version",),
    "EVAL_GATE_RESULT": ("gate_id", "result", "severity", "evidence_pointers", "message"),
    "EVAL_COMPLETED": ("gates_executed", "gates_failed_blocker", "gates_failed_total"),
    "EXPORT_REQUESTED": ("requested_by", "export_targets", "policy_mode"),
    "EXPORT_BLOCKED": ("block_reason", "failed_gate_ids"),
    "EXPORT_COMPLETED": ("bundle_path", "bundle_sha256", "bundle_version", "validator_result"),
    "EGRESS_REQUEST_ALLOWED": ("destination", "allowlist_rule_id", "request_hash_sha256", "evidence_origin"),
    "EGRESS_REQUEST_BLOCKED": ("destination", "block_reason", "request_hash_sha256", "evidence_origin"),
    "MODEL_SELECTION_RESOLVED": ("task_type", "selected_model_id", "pinning_level", "adapter_id", "adapter_endpoint"),
    "MODEL_CALL_STARTED": ("call_id", "task_type", "input_artifact_refs", "request_hash_sha256", "timeout_ms"),
    "MODEL_CALL_COMPLETED": ("call_id", "response_hash_sha256", "duration_ms"),
    "MODEL_CALL_FAILED": ("call_id", "error_category", "error_code", "error_message_redacted"),
    "NO_AI_MODE_USED": ("reason", "affected_tasks"),
    "REDACTION_APPLIED": ("artifact_id", "redaction_type", "region", "reason", "policy_rule_id"),
    "REDACTION_VALIDATION_RESULT": ("result", "missing_required_redactions"),
    "CITATION_VALIDATION_RESULT": ("result", "claims_total", "claims_missing_citations", "locator_schema_version"),
    "BUNDLE_VALIDATION_RESULT": ("result", "failed_checks", "validator_version"),
    "VAULT_ENCRYPTION_STATUS": ("encryption_at_rest", "algorithm", "key_storage"),
    "VAULT_KEY_ROTATED": ("old_key_id", "new_key_id"),
    "DELETION_REQUESTED": ("artifact_ids", "requested_by"),
    "DELETION_COMPLETED": ("artifact_ids_deleted", "blob_delete_method", "sqlite_compaction_attempted", "result"),
    "RUN_COMPLETED": (),
    "RUN_FAILED": (),
    "RUN_CANCELLED": (),
    "DETERMINISM_PROFILE_SET": (),
    "DETERMINISM_DOWNGRADED": (),
    "DETERMINISM_VALIDATION_RESULT": (),
    "BUNDLE_GENERATION_STARTED": (),
    "BUNDLE_GENERATION_COMPLETED": (),
    "BUNDLE_VALIDATION_STARTED": (),
    "EXPORT_FAILED": (),
}
ORIGINS = ("CONTROL_SIMULATION", "RUNTIME_OBSERVATION")
CHAIN = "run_id string, line_no long, prev_event_hash string, event_hash string"


def envelope() -> tuple[Column, Column]:
    """An event's canonical text before and after its prev_event_hash; event_hash counts as zeros."""
    value = lambda c: F.expr("substring({0}, 6, length({0}) - 6)".format(f"to_json(named_struct('x', {c}), map('ignoreNullFields', 'false'))"))
    head = F.concat(F.lit('{"actor":'), value("actor"), F.lit(',"details":'), canonical(F.coalesce("details", F.lit("null"))), F.lit(f',"event_hash":"{ZERO}","event_type":'), value("event_type"), F.lit(',"prev_event_hash":"'))
    tail = F.concat(F.lit('","run_id":'), value("run_id"), F.lit(',"ts_utc":'), value("ts_utc"), F.lit(',"vault_id":'), value("vault_id"), F.lit("}"))
    return head, tail


def build_chain(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, line_no, prev_event_hash, event_hash) and the columns ``keep`` of an event: each run's events chained in order of line_no.

    A run's chain is sequential by nature: rows are dealt by run, sorted, and hashed as a stream, so that a
    run of any length needs the memory of one row; different runs go on side by side. Ties in
    line_no are taken in order of their text.
    """
    head, tail = envelope()
    rows = events.select("run_id", F.col("line_no").cast("long"), head.alias("head"), tail.alias("tail"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    schema = ", ".join([CHAIN, *[f"__k{i} {events.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = None, ZERO
        for batch in batches:
            runs, heads, tails = (batch.column(i).to_pylist() for i in (0, 2, 3))
            prevs, hashes = [], []
            for r, h, t in zip(runs, heads, tails):
                if r != run:
                    run, last = r, ZERO
                prevs.append(last)
                last = hashlib.sha256(f"{h}{last}{t}".encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prevs, pa.string()), pa.array(hashes, pa.string()), *batch.columns[4:]], ["run_id", "line_no", "prev_event_hash", "event_hash", *batch.schema.names[4:]])

    out = rows.repartition("run_id").sortWithinPartitions("run_id", "line_no", "head", "tail").mapInArrow(fold, schema)
    return out.withColumnsRenamed({f"__k{i}": c for i, c in enumerate(keep)})


def ordered_sha256(rows: DataFrame, key: str, order: list[str], sep: str = "") -> DataFrame:
    """(key, sha256): the SHA-256 of each group's ``text`` column in an order, joined by ``sep``. Null texts are left out.

    Rows are dealt by group, sorted, and hashed as a stream: a group of any size needs the memory of a batch. A hash is sequential in its group by nature; groups go on side by side.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, some = None, None, False
        done: tuple[list, list] = ([], [])

        def close() -> None:
            done[0].append(now)
            done[1].append(held.hexdigest())

        for batch in batches:
            keys, texts = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if held is None or keys[i] != now:
                    if held is not None:
                        close()
                    held, now, some = hashlib.sha256(), keys[i], False
                mine = [t for t in texts[i:j] if t is not None]
                if mine:
                    held.update(((sep if some else "") + sep.join(mine)).encode())
                    some = True
                i = j
            if len(done[0]) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema.field(0).type), pa.array(done[1])], ["key", "sha256"])
                done = ([], [])
        if held is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema.field(0).type), pa.array(done[1])], ["key", "sha256"])

    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.repartition(key).sortWithinPartitions(key, *order).select(F.col(key).alias("key"), "text")
    return dealt.mapInArrow(fold, f"key {kind}, sha256 string").withColumnRenamed("key", key)


def before(rows: DataFrame, value: Column | str, key: str = "run_id", order: str = "line_no", name: str = "before", block: int = 100_000) -> DataFrame:
    """``rows`` with the ``value`` of the row before each in its group, null for the first; ``order`` is a whole number, unique in a group.

    Windows run over blocks of ``block`` numbers, and the first row of a block takes the last value of the block before it, so a group
    of any size is spread over tasks. Columns ``__b``, ``__v`` and ``__prev`` are used inside.
    """
    cut = rows.withColumns({"__b": F.floor(F.col(order) / block), "__v": F.struct((F.col(value) if isinstance(value, str) else value).alias("x"))})
    lasts = cut.groupBy(key, "__b").agg(F.max_by("__v", order).alias("__prev"))
    lasts = lasts.withColumn("__prev", F.lag("__prev").over(Window.partitionBy(key).orderBy("__b")))
    within = F.lag("__v").over(Window.partitionBy(key, "__b").orderBy(order))
    out = cut.withColumn("__v", within).join(lasts, [key, "__b"], "left")
    return out.withColumn(name, F.coalesce("__v", "__prev")["x"]).drop("__b", "__v", "__prev")


def verify_chain(events: DataFrame) -> DataFrame:
    """Per run: events, broken links, wrong hashes, the first bad line and the verdict. ``events`` has both hashes as well.

    Hashes are checked row by row, links by blocks of lines (see ``before``).
    """
    head, tail = envelope()
    own = F.sha2(F.concat(head, F.col("prev_event_hash"), tail).cast("binary"), 256) == F.col("event_hash")
    rows = before(events.select("run_id", "line_no", own.alias("own"), "event_hash", "prev_event_hash"), "event_hash", name="last")
    rows = rows.withColumn("linked", F.coalesce("last", F.lit(ZERO)) == F.col("prev_event_hash"))
    bad = ~(F.coalesce("own", F.lit(False)) & F.coalesce("linked", F.lit(False)))
    out = rows.groupBy("run_id").agg(F.count("*").alias("n_events"), F.count_if(~F.coalesce("linked", F.lit(False))).alias("n_unlinked"), F.count_if(~F.coalesce("own", F.lit(False))).alias("n_altered"), F.min(F.when(bad, F.col("line_no"))).alias("first_bad_line"))
    return out.withColumn("result", F.when(F.col("first_bad_line").isNull(), "PASS").otherwise("FAIL"))


def taxonomy(events: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED) -> DataFrame:
    """Each event with the detail keys it lacks and the verdict: ok, unknown event_type, missing keys or a bad evidence_origin."""
    table = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]).cast("array<string>"))])
    rows = events.withColumn("required", F.try_element_at(table, F.col("event_type")))
    rows = rows.withColumn("lacks", F.array_join(F.array_sort(missing_keys(F.col("details"), F.col("required"))), ","))
    origin = F.coalesce(F.get_json_object("details", "$.evidence_origin"), F.lit(""))
    verdict = F.when(F.col("required").isNull(), "unknown event_type").when(F.col("lacks") != "", "missing keys").when(F.col("event_type").isin("EGRESS_REQUEST_ALLOWED", "EGRESS_REQUEST_BLOCKED") & ~origin.isin(*ORIGINS), "bad evidence_origin").otherwise("ok")
    return rows.withColumn("verdict", verdict).drop("required")


def illegal_transitions(states: DataFrame, legal: dict[str, tuple[str, ...]] = TRANSITIONS, always: str = "CANCELLED") -> DataFrame:
    """Changes of state (run_id, line_no, state) that are not legal: run_id, line_no, from_state, to_state."""
    edges = [f"{a}>{b}" for a, bs in legal.items() for b in bs]
    rows = before(states.select("run_id", "line_no", F.col("state").alias("to_state")), "to_state", name="from_state").where("from_state is not null")
    return rows.where((F.col("to_state") != always) & ~F.concat_ws(">", "from_state", "to_state").isin(edges))
