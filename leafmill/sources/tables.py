"""Explicit schemas of the page-pipeline tables, and their scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PAGE = "job_id string, page_number int, sub_page_index int"
SCHEMAS = {
    "users": "user_id string, username string, role string, created_at timestamp",
    "jobs": "job_id string, collection_id string, material_type string, pipeline_mode string, status string, shadow_mode boolean, page_count int, created_by string, created_at timestamp, completed_at timestamp",
    "job_pages": f"page_id string, {_PAGE}, status string, routing_path string, input_uri string, output_uri string, quality_summary string, layout_consensus_result string, review_reasons string, qa_approved boolean, reading_order int, retry_count int, processing_time_ms double, status_updated_at timestamp, created_at timestamp",
    "page_lineage": f"lineage_id string, {_PAGE}, material_type string, input_hash string, output_uri string, geometry_a_used boolean, geometry_b_used boolean, human_corrected boolean, human_correction_timestamp timestamp, human_correction_fields string, acceptance_decision string, gate_results string, created_at timestamp",
    "service_invocations": "id long, lineage_id string, service_name string, status string, invoked_at timestamp, processing_time_ms double, metrics string",
    "quality_gate_log": f"gate_id string, {_PAGE}, gate_type string, route_decision string, review_reason string, payload string, created_at timestamp",
    "model_versions": "model_id string, service_name string, version_tag string, stage string, gate_results string, promoted_at timestamp, created_at timestamp",
    "policy_versions": "version string, config string, applied_at timestamp",
    "task_retries": "task_id string, page_id string, attempt int, error string, at timestamp",
    "retraining_triggers": "trigger_id long, trigger_type string, metric_name string, metric_value double, threshold_value double, status string, train_job_id string, cooldown_until timestamp, fired_at timestamp",
    "retraining_jobs": "train_job_id string, pipeline string, status string, dataset_version string, started_at timestamp, completed_at timestamp, error_message string",
    "shadow_evaluations": "eval_id string, page_id string, candidate_model string, delta double, created_at timestamp",
    "model_audit_log": "audit_id string, model_id string, action string, forced boolean, notes string, at timestamp",
    "slo_audit_samples": "sample_id string, page_id string, material_type string, auto_accepted boolean, flagged boolean, audited_at timestamp",
}


def scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Parquet rows of a table under its fixed schema: nothing is inferred, filters and columns reach the scan."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)
