"""Weights, rates, calendars, rewards and bands.

These numbers and names must equal the published ones for results to agree, so they
are stated as they are, in their published order.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from decisionlab import schema
from decisionlab.sources.events import load_weights

BASE_LOGIT = "1.3957"

# Weights of version v10_68: (category, signal, weight).
WEIGHTS_V10_68 = [
    ("designation", "BTD", "0.1676"),
    ("designation", "orphan", "0.1469"),
    ("designation", "fast_track", "0.0888"),
    ("designation", "priority_review", "0.1053"),
    ("designation", "RMAT", "0.15"),
    ("designation", "accelerated_approval", "0.12"),
    ("sponsor", "experienced_sponsor", "0.9387"),
    ("sponsor", "inexperienced_sponsor", "-1.2875"),
    ("sponsor", "prior_approval", "0.3"),
    ("sponsor", "prior_CRL", "-3.3533"),
    ("sponsor", "resubmission_post_CRL", "1.5"),
    ("sponsor", "advisory_committee_favorable", "0.8212"),
    ("sponsor", "advisory_committee_unfavorable", "-1.5069"),
    ("area", "ta_low_risk", "0.1531"),
    ("area", "ta_moderate_risk", "-0.0532"),
    ("area", "ta_high_risk", "-0.2555"),
    ("area", "ta_very_high_risk", "-0.5"),
    ("manufacturing", "form_483", "-1.3552"),
    ("manufacturing", "import_alert", "-0.8"),
    ("manufacturing", "manufacturing_warning", "-0.5"),
    ("manufacturing", "cGMP_violation", "-0.6"),
    ("endpoint", "primary_endpoint_met", "0.45"),
    ("endpoint", "primary_endpoint_missed", "-1.8"),
    ("endpoint", "surrogate_only", "-0.45"),
    ("endpoint", "biomarker_primary", "-0.3"),
    ("endpoint", "PRO_endpoint", "-0.15"),
    ("endpoint", "composite_endpoint", "-0.1"),
    ("competition", "first_in_class", "0.45"),
    ("competition", "unmet_need", "0.55"),
    ("competition", "crowded_market", "-0.2"),
    ("competition", "designation_stack", "0.35"),
    ("interaction", "novice_high_risk_ta", "-0.4071"),
    ("interaction", "experienced_low_risk", "0.2"),
    ("interaction", "interaction_inexperienced_mfg", "-0.5"),
    ("interaction", "interaction_prior_crl_mfg", "-0.7"),
    ("interaction", "accelerated_approval_non_onc", "-0.3"),
    ("interaction", "surrogate_clinical_disconnect", "-0.35"),
    ("interaction", "designation_surrogate_penalty", "-0.25"),
    ("interaction", "small_pivotal_n", "-0.2"),
    ("interaction", "single_arm_pivotal", "-0.15"),
    ("interaction", "cber_advanced_therapy", "-0.12"),
    ("interaction", "repurposed_failed_compound", "-0.2"),
    ("interaction", "early_action_risk", "-0.15"),
    ("interaction", "serial_crl_penalty", "-0.5"),
    ("interaction", "novel_manufacturing_platform", "-0.18"),
    ("interaction", "efficacy_magnitude_weak", "-0.25"),
    ("interaction", "post_hoc_subgroup_primary", "-0.3"),
    ("interaction", "safety_signal_liver", "-0.35"),
    ("interaction", "safety_signal_cardiac", "-0.4"),
    ("interaction", "competitor_crl_same_class", "-0.15"),
]

# What version v10_69 sets on top of v10_68.
WEIGHTS_V10_69_CHANGES = [
    ("new", "prior_CRL_cmc_only", "-1.0"),
    ("new", "hys_law_cases", "-1.5"),
    ("new", "fda_benefit_risk_negative", "-1.5"),
    ("new", "novel_delivery_mechanism", "-0.4"),
    ("new", "human_factors_risk", "-0.4"),
    ("new", "fda_no_adcom_required", "0.2"),
    ("new", "crl_time_decay_1yr", "0.0"),
    ("new", "crl_time_decay_2yr", "0.15"),
    ("new", "crl_time_decay_3yr", "0.30"),
    ("new", "crl_time_decay_4yr_plus", "0.45"),
    ("interaction", "safety_signal_liver", "-0.60"),
    ("interaction", "efficacy_magnitude_weak", "-0.45"),
    ("sponsor", "resubmission_post_CRL", "2.0"),
    ("interaction", "experienced_sponsor_safety_override", "-0.5"),
    ("interaction", "pk_bridging_vs_clinical", "-0.2"),
]

# tier -> (call, position, exit window, runner)
TIER_POLICY = {
    "TIER_1": ("BUY", "STANDARD_POSITION", "T-5 to T-7", "20%"),
    "TIER_2": ("BUY", "STANDARD_POSITION", "T-5 to T-7", "20%"),
    "TIER_3": ("RUNUP_ONLY", "SMALL_POSITION_EARLY_EXIT", "T-5 to T-7", "20%"),
    "TIER_4": ("AVOID", "NO_POSITION", "N/A", "0%"),
}
TIERS = list(TIER_POLICY)

DECISION_TYPES = ["PDUFA", "PDUFA (Expected)"]
READOUT_TYPES = ["Phase 2 Readout", "Phase 3 Readout"]

# (last day out, zone, progress); beyond the last bound the zone is FAR, before day 0 EXPIRED.
WINDOW_ZONES = [
    (3, "DANGER", 95),
    (7, "EXIT", 85),
    (14, "PEAK", 70),
    (25, "OPTIMAL", 45),
    (45, "EARLY", 20),
]
EXPIRED_ZONE = ("EXPIRED", 100)
FAR_ZONE = ("FAR", 5)

# area -> (approved, total, rate)
AREA_RATES = {
    "Oncology": (68, 78, 87.2),
    "Immunology": (22, 25, 88.0),
    "Infectious Disease": (41, 45, 91.1),
    "Dermatology": (18, 20, 90.0),
    "Vaccines": (12, 13, 92.3),
    "Respiratory": (15, 17, 88.2),
    "CNS": (38, 52, 73.1),
    "Cardiovascular": (19, 24, 79.2),
    "Metabolic": (24, 31, 77.4),
    "Rare Disease": (45, 55, 81.8),
    "Hematology": (28, 34, 82.4),
    "Ophthalmology": (9, 13, 69.2),
    "GI/Hepatology": (12, 16, 75.0),
    "Nephrology": (6, 9, 66.7),
    "Musculoskeletal": (8, 11, 72.7),
    "Women's Health": (5, 6, 83.3),
    "Pain Management": (3, 7, 42.9),
}

AREA_RISK = {
    "LOW_RISK": ["Oncology", "Immunology", "Dermatology", "Vaccines", "Infectious Disease"],
    "MOD_RISK": ["CNS", "Cardiovascular", "Metabolic", "Rare Disease", "Respiratory"],
    "HIGH_RISK": ["Ophthalmology", "GI/Hepatology", "Nephrology", "Hematology", "Musculoskeletal"],
}

# (name, dates, abstract release, month, area, tier)
CONFERENCES = [
    ("ASCO GI", "Jan 22-24, 2026", "2026-01-08", 1, "Oncology", "Major"),
    ("AACR Annual", "Apr 11-16, 2026", "2026-03-15", 4, "Oncology", "Major"),
    ("AAN Annual", "Apr 25-30, 2026", "2026-03-20", 4, "CNS", "Major"),
    ("ASCO Annual", "May 29 - Jun 2, 2026", "2026-05-14", 5, "Oncology", "Tier 1"),
    ("EHA Annual", "Jun 11-14, 2026", "2026-05-28", 6, "Hematology", "Major"),
    ("ESMO", "Sep 18-22, 2026", "2026-08-20", 9, "Oncology", "Tier 1"),
    ("ASH Annual", "Dec 5-8, 2026", "2026-11-10", 12, "Hematology", "Tier 1"),
    ("ACR Convergence", "Nov 13-18, 2026", "2026-10-15", 11, "Immunology", "Major"),
    ("ADA Scientific Sessions", "Jun 12-15, 2026", "2026-05-20", 6, "Endocrinology", "Major"),
    ("EASL Congress", "Jun 24-28, 2026", "2026-06-01", 6, "Hepatology", "Major"),
    ("IDWeek", "Oct 15-18, 2026", "2026-09-15", 10, "Infectious Disease", "Major"),
    ("AHA Scientific Sessions", "Nov 14-17, 2026", "2026-10-20", 11, "Cardiovascular", "Tier 1"),
]

MODALITY_MULTIPLIER = {
    "Small Molecule": 1.0,
    "Monoclonal Antibody": 1.5,
    "ADC": 2.0,
    "Gene Therapy": 3.0,
    "Cell Therapy": 3.0,
    "mRNA": 2.0,
    "Biologic": 1.5,
    "Default": 1.0,
}

COIN_REWARDS = {
    "PREDICTION_MADE": 10,
    "CORRECT_BINARY": 50,
    "CORRECT_GRANULAR": 100,
    "STREAK_3": 75,
    "STREAK_5": 200,
    "STREAK_10": 500,
    "EARLY_BIRD": 25,
    "CONTRARIAN_WIN": 150,
    "FIRST_PREDICTION": 25,
}
STREAK_LENGTHS = [3, 5, 10]
EARLY_DAYS = 14
CONTRARIAN_PCT = 30

# (tier, least balance), rising.
COIN_TIERS = [
    ("INITIATE", 0),
    ("ANALYST", 250),
    ("STRATEGIST", 1000),
    ("ORACLE", 2500),
    ("TITAN", 5000),
    ("LEGEND", 10000),
]

DECISION_LABELS = ["APPROVE", "CRL"]
READOUT_LABELS = ["BEAT", "MEET", "MISS"]
WIN_OUTCOMES = ["APPROVED", "POSITIVE", "BEAT", "MEET"]

# Long designation name -> short form.
DESIGNATION_SHORT = {
    "Breakthrough Therapy": "BTD",
    "Priority Review": "PR",
    "Orphan Drug": "OD",
    "Fast Track": "FT",
    "Accelerated Approval": "AA",
}

# Platform name in the feed -> display name.
PLATFORM_NAMES = {
    "Tweet": "X / Twitter",
    "Reddit Post": "Reddit",
    "Tiktok Video": "TikTok",
    "Youtube Video": "YouTube",
}

# Whole years since the last rejection -> signal (its weight is in the weight table).
DECAY_SIGNALS = [
    (1, "crl_time_decay_1yr"),
    (2, "crl_time_decay_2yr"),
    (3, "crl_time_decay_3yr"),
    (4, "crl_time_decay_4yr_plus"),
]

# Abramowitz-Stegun 7.1.26 error function coefficients.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
RISK_FREE_RATE = 0.05


def local_table(spark: SparkSession, rows: list[tuple], columns: T.StructType) -> DataFrame:
    """A small table whose size Spark knows, so that joins with it need no shuffle."""
    table = pa.table({name: [row[i] for row in rows] for i, name in enumerate(columns.names)})
    return spark.createDataFrame(table, schema=columns)


def weights_table(spark: SparkSession, version: str = "v10_68") -> DataFrame:
    """The weight table of one version; the later one inherits the earlier and sets its changes."""

    def rows(name: str, weights: list[tuple[str, str, str]]) -> DataFrame:
        data = [(name, signal, category, Decimal(w)) for category, signal, w in weights]
        return local_table(spark, data, schema.SIGNAL_WEIGHT)

    base = rows("v10_68", WEIGHTS_V10_68)
    if version == "v10_68":
        return base
    if version != "v10_69":
        raise ValueError(f"unknown weight version {version!r}")
    return load_weights(base, rows(version, WEIGHTS_V10_69_CHANGES), version)


def area_rates_table(spark: SparkSession) -> DataFrame:
    return local_table(
        spark, [(area, *row) for area, row in AREA_RATES.items()], schema.AREA_RATE
    )


def conferences_table(spark: SparkSession) -> DataFrame:
    rows = [
        (name, dates, date.fromisoformat(release), month, area, tier)
        for name, dates, release, month, area, tier in CONFERENCES
    ]
    return local_table(spark, rows, schema.CONFERENCE)


def area_risk_table(spark: SparkSession) -> DataFrame:
    rows = [(area, risk) for risk, areas in AREA_RISK.items() for area in areas]
    return local_table(spark, rows, schema.AREA_RISK)


def modality_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(MODALITY_MULTIPLIER.items()), schema.MODALITY)
