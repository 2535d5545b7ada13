"""Small designs with known answers."""

import json

SPAN = {"SRC-SPAN-A": ["N01", "C01"], "SRC-SPAN-B": ["N02", "C02", "C03"], "SRC-SPAN-C": ["N03", "C04"], "SRC-M5": ["C05", "C06", "C07", "C08", "C09"], "SRC-M3": ["C10", "C11", "C12"], "SRC-M2a": ["C03", "C13"], "SRC-M2b": ["C01", "C02"]}
LOADS = {"C03": 8, "C05": 5, "C06": 4, "C02": 3, "C07": 3, "C08": 2, "C09": 2, "C10": 2, "C11": 2, "C04": 1, "C12": 1, "C13": 1, "C14": 1}


def worked_rows():
    """84 rows: source, unit, group, weight, laboratory."""
    pairs = [("SRC-HUB", f"N{i:02}") for i in range(1, 31)]
    pairs += [(s, u) for s, units in SPAN.items() for u in units]
    single = [u for u, n in LOADS.items() for _ in range(n)]
    pairs += [(f"SRC-{i:02}", u) for i, u in enumerate(single)]
    return [(s, u, "Normal" if u[0] == "N" else "Cancer", 100.0 if s == "SRC-HUB" else 1.0, "LAB-HUB" if s == "SRC-HUB" else "LAB-OTHER") for s, u in pairs]


WORKED_SCHEMA = "source string, unit string, `group` string, weight double, laboratory string"
WORKED = {"h_group": 0.9666186325481028, "h_group_given_source": 0.08041532740670795, "ratio": 0.08319240360050288}


def worked(spark):
    return spark.createDataFrame(worked_rows(), WORKED_SCHEMA)


def config(**changes):
    """A configuration over the worked design's columns."""
    base = {
        "schema_version": "0.1-draft", "name": "worked", "columns": {"source": ["source"], "unit": ["unit"], "group": ["group"]}, "grain": {"name": "deposit", "description": "one data deposit"},
        "unit_description": "a specimen",
    }
    return json.loads(json.dumps(base | changes))
