"""Explicit schemas of every table read from or written to files."""

from __future__ import annotations

EXAMPLE = (
    "source string, source_file string, test_name string, spec_id string, impl_id string, "
    "spec_text string, impl_text string, status string, buggy_lines array<int>, outcome string, "
    "bug_type string, failure_symptoms string, rep_index int, verifier_log string, sibling_impl_id string"
)
EVAL_RECORD = (
    "impl_id string, spec_id string, source string, source_file string, test_name string, status string, "
    "whole_impl_energy double, per_line_energies array<double>, buggy_line_indices array<int>, "
    "scorable_line_texts array<string>"
)
TRAJECTORY = (
    "status string, verified_code string, original_item string, original_index long, repetition int, "
    "log string, return_code int"
)
REPAIR_PAIR = "input string, output string, rewrite_reason string, status string"
HISTORY = (
    "_step long, `train/step` long, `train/epoch` long, `train/loss` double, `train/loss_spec` double, "
    "`train/loss_line` double, `train/lse_temperature` double, `train/lr` double, `eval/step` long, "
    "`eval/auroc` double, `eval/per_line_top1` double, `eval/per_line_top3` double, "
    "`eval/within_spec_ranking_acc` double, `eval/n_impls` long"
)
TASK = (
    "task_id string, entry_point string, declaration string, docstring string, canonical_solution string, "
    "buggy_solution string, bug_type string, failure_symptoms string"
)
IMPL_POINT = (
    "impl_id string, spec_id string, status string, whole_impl_energy double, n_lines int, "
    "has_pass_sibling boolean, spec_text string, impl_text string, x double, y double"
)
REPAIR_RESULT = (
    "impl_id string, spec_id string, skipped string, baseline_orig_impl_verifies boolean, "
    "arm_a_specialist_verifies boolean, arm_b_llm_only_verifies boolean, arm_c_llm_self_verifies boolean"
)
