"""Schemas of the log model."""

from __future__ import annotations

HEADERS = "array<struct<key:string,value:binary>>"
LOG = (
    "topic string, partition int, offset bigint, timestamp_ms bigint, producer_id bigint, producer_epoch int, sequence int, "
    f"key binary, value binary, headers {HEADERS}"
)
OFFSETS = "group_id string, topic string, partition int, next_offset bigint, commit_seq bigint"
GROUP_EVENT = (
    "group_id string, seq bigint, now_ms bigint, op string, member_id string, generation_id int, protocol_type string, protocol_name string, "
    "topics array<string>, session_timeout_ms int, rebalance_timeout_ms int, assignments map<string,binary>"
)
META_EVENT = (
    "seq bigint, kind string, topic_name string, partition_index int, leader_id int, leader_epoch int, replicas array<int>, isr array<int>, "
    "broker_id int, log_end_offset bigint, last_caught_up_ms bigint, target_replicas array<int>, step string, controller_id int, host string, port int"
)
#: Error codes of outcomes.
OK, UNKNOWN_PARTITION, NOT_LEADER, STALE_GENERATION, UNKNOWN_MEMBER, OUT_OF_ORDER, STALE_EPOCH, UNKNOWN_PRODUCER = 0, 3, 6, 22, 25, 45, 47, 59
