"""Schemas of the tables the operators read."""

LOG_EVENTS = (
    "timestamp timestamp_ntz, node_name string, log_type string, message string, support_bundle string, file string, "
    "long_op_value double, timing_real_value double"
)
LOG_LINES = "file_path string, line_block bigint, line_no bigint, line string"
REPORTS = "id string, support_bundle_name string, json_report string, created_at timestamp_ntz, created_date date"
BUNDLE_HEADER = (
    "support_bundle string, cluster_name string, cluster_uuid string, organization string, case_id bigint, "
    "timestamp timestamp_ntz"
)
BUNDLE_FLAGS = "support_bundle string, node_name string, server_type string, gflag string, value string"
NODE_INVENTORY = (
    "support_bundle string, node_name string, state string, is_master boolean, is_tserver boolean, cloud string, "
    "region string, az string, num_cores int, mem_size_gb decimal(18,2), volume_size_gb decimal(18,2)"
)
