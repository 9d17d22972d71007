"""Longitudinal cohort assembly and time-to-event analysis on Spark DataFrames."""

from .functions.columns import (
    any_flag, apply_labels, first_set, flag_when, gt_missing_low, le_missing_low,
    lt_missing_low, nullify, override, recode, rename_all, round_even,
    select_numbered, select_prefix, try_number, wall_micros,
)
from .operators.cox import CoxModel, complete_cases, cox_fit, fit_together
from .operators.describe import (
    daily_counts, daily_prevalence, describe_categorical, describe_continuous,
    freq, freq_percent, longitudinal_points, missing_profile,
)
from .operators.finegray import finegray_expand, finegray_fit
from .operators.joins import (
    asof_join, assert_unique, check_unique, first_match_rows, first_match_visit, interval_join, lookup_neighbor,
    merge_full, merge_left, merge_left_many, treatment_onsets,
)
from .operators.landmark import (
    landmark_counts, landmark_cut, landmark_grid, landmark_supermodel,
)
from .operators.longitudinal import (
    any_by_subject, baseline_rows, counting_process, dedupe_by_key,
    diagnostic_visit, expand_days, final_event_date, first_per_group,
    last_per_group, locf, neighbor_visits, next_state, response_label,
    union_cohorts, vanished_subjects,
)
from .operators.multistate import (
    assign_states, expand_transitions, probabilities_long, transition_cox,
    transition_hazards, transition_matrix, transition_probabilities,
)
from .operators.report import (
    all_models_table, endpoint_table, significance_mark,
)
from .operators.reshape import FIRST_TOKEN, LAST_TOKEN, gather, long_to_wide, number_visits, visit_sequence, wide_to_long
from .operators.risk import (
    censoring_weights, combined_endpoint, compare_km_cif, cumulative_incidence,
    kaplan_meier, nelson_aalen, relevel_event, risk_table, survival_response,
)
from .sources.io import drop_work, read_table, write_table

__all__ = [name for name in dir() if not name.startswith("_")]
