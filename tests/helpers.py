"""Small tables for tests and the golden backtest read from FIXTURES.md."""

import os
import re

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def golden_backtest():
    """(ticker, outcome, signals, adj68, p68, tier68, p69, tier69, change) of the 22 events."""
    with open(os.path.join(ROOT, "FIXTURES.md")) as f:
        lines = [x for x in f if re.match(r"^\| [A-Z]+ \| (APPROVED|CRL) \|", x)]
    out = []
    for line in lines:
        c = [x.strip() for x in line.strip().strip("|").split("|")]
        out.append((c[0], c[1], c[2].split(", "), float(c[3]), float(c[4]), c[5], float(c[6]), c[7], c[8]))
    return out


# Signal changes of the golden backtest: event -> (dropped, set).
GOLDEN_CHANGES = {
    "MIST": (["prior_CRL"], ["prior_CRL_cmc_only", "resubmission_post_CRL"]),
    "FBIO": (["prior_CRL"], ["prior_CRL_cmc_only", "resubmission_post_CRL"]),
    "OMER": ([], ["crl_time_decay_4yr_plus", "resubmission_post_CRL", "fda_no_adcom_required"]),
    "GSK": ([], ["resubmission_post_CRL"]),
    "ATRA": ([], ["resubmission_post_CRL"]),
    "SNY": ([], [
        "hys_law_cases", "fda_benefit_risk_negative", "experienced_sponsor_safety_override",
        "safety_signal_liver", "efficacy_magnitude_weak",
    ]),
    "AQST": ([], ["novel_delivery_mechanism", "human_factors_risk", "pk_bridging_vs_clinical"]),
}
