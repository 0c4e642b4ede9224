"""Explicit schemas of run files; arguments are VARIANT. A check's copy of its action is for display alone: a map keeps the order."""

from __future__ import annotations

from pyspark.sql.types import StructType

CALL = "STRUCT<id: STRING, name: STRING, arguments: VARIANT, requestor: STRING>"
MESSAGE = f"STRUCT<role: STRING, content: STRING, turn_idx: INT, timestamp: STRING, cost: DOUBLE, usage: STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>, tool_calls: ARRAY<{CALL}>, id: STRING, requestor: STRING, error: BOOLEAN>"
RESULT = "STRUCT<id: STRING, role: STRING, content: STRING, requestor: STRING, error: BOOLEAN, timestamp: STRING>"
CHUNK = "STRUCT<content: STRING, timestamp: STRING, contains_speech: BOOLEAN, utterance_ids: ARRAY<STRING>, turn_taking_action: STRUCT<action: STRING, info: STRING>>"
TICK = f"STRUCT<tick_id: INT, timestamp: STRING, agent_chunk: {CHUNK}, user_chunk: {CHUNK}, agent_tool_calls: ARRAY<{CALL}>, user_tool_calls: ARRAY<{CALL}>, agent_tool_results: ARRAY<{RESULT}>, user_tool_results: ARRAY<{RESULT}>, user_transcript: STRING>"
ACTION = "STRUCT<action_id: STRING, requestor: STRING, name: STRING, arguments: VARIANT, compare_args: ARRAY<STRING>>"
REWARD = (
    "STRUCT<reward: DOUBLE, reward_basis: ARRAY<STRING>, reward_breakdown: MAP<STRING, DOUBLE>, db_check: STRUCT<db_match: BOOLEAN, db_reward: DOUBLE>,"
    " action_checks: ARRAY<STRUCT<action: STRUCT<name: STRING, requestor: STRING, arguments: MAP<STRING, STRING>>, action_match: BOOLEAN, action_reward: DOUBLE, tool_type: STRING>>,"
    " env_assertions: ARRAY<STRUCT<met: BOOLEAN, reward: DOUBLE>>, communicate_checks: ARRAY<STRUCT<info: STRING, met: BOOLEAN>>, nl_assertions: ARRAY<STRUCT<nl_assertion: STRING, met: BOOLEAN>>>"
)
ERROR = "STRUCT<source: STRING, severity: STRING, error_tags: ARRAY<STRING>, turn_idx: INT, tick_start: INT, tick_end: INT>"
SIMULATION = (
    f"STRUCT<id: STRING, task_id: STRING, trial: INT, seed: INT, mode: STRING, start_time: STRING, end_time: STRING, duration: DOUBLE, termination_reason: STRING,"
    f" agent_cost: DOUBLE, user_cost: DOUBLE, messages: ARRAY<{MESSAGE}>, ticks: ARRAY<{TICK}>, reward_info: {REWARD}, auth_classification: STRUCT<status: STRING>, info: STRUCT<had_unresponsive_period: BOOLEAN>, review: STRUCT<errors: ARRAY<{ERROR}>>>"
)
TASK = f"STRUCT<id: STRING, evaluation_criteria: STRUCT<actions: ARRAY<{ACTION}>, env_assertions: ARRAY<STRUCT<env_type: STRING, func_name: STRING, arguments: VARIANT, assert_value: BOOLEAN>>, communicate_info: ARRAY<STRING>, nl_assertions: ARRAY<STRING>, reward_basis: ARRAY<STRING>>, required_documents: ARRAY<STRING>>"
INDEX = "STRUCT<id: STRING, task_id: STRING, trial: INT, reward: DOUBLE, termination_reason: STRING, agent_cost: DOUBLE, duration: DOUBLE>"
INFO = "STRUCT<git_commit: STRING, num_trials: INT, max_steps: INT, max_errors: INT, seed: INT, agent_info: STRUCT<implementation: STRING, llm: STRING, llm_args: VARIANT>, user_info: STRUCT<implementation: STRING, llm: STRING, llm_args: VARIANT>, environment_info: STRUCT<domain_name: STRING>>"


def struct(ddl: str) -> StructType:
    """The struct type of a ``STRUCT<...>`` text."""
    return StructType.fromDDL(f"x {ddl}").fields[0].dataType


def run_schema() -> StructType:
    """A run file: info, tasks, simulations and the index of simulations."""
    return StructType.fromDDL(f"timestamp STRING, info {INFO}, tasks ARRAY<{TASK}>, simulations ARRAY<{SIMULATION}>, simulation_index ARRAY<{INDEX}>")
