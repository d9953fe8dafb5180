"""Classes of findings and of source files: ordered first-match tables, and tables of flags."""

from __future__ import annotations

from ..functions import values as V
from ..functions.dialect import Dialect


def _joined(d: Dialect, *columns: str) -> str:
    """Columns with a space between; null as nothing."""
    return "concat(" + ", ' ', ".join(f"COALESCE({c}, '')" for c in columns) + ")"


def _texts(d: Dialect) -> dict[str, str]:
    """The texts that tables look at, by name."""
    two = _joined(d, "title", "explanation")
    return {"whole": _joined(d, "title", "explanation", "category"), "told": two, "way": _joined(d, "explanation", "exploit_chain"), "told_low": f"lower({two})", "short_low": "lower(concat(title, category))"}


def root_family(d: Dialect, text: str | None = None) -> str:
    return d.first(text or _texts(d)["whole"], V.ROOT_FAMILIES, "unknown")


def root_sink(d: Dialect, text: str | None = None) -> str:
    return d.first(text or _texts(d)["told"], V.ROOT_SINKS, "unknown")


def root_zone(d: Dialect, text: str | None = None) -> str:
    return d.first(text or _texts(d)["way"], V.ROOT_ZONES, "internal")


def cluster_family(d: Dialect, text: str | None = None) -> str:
    return d.first(text or _texts(d)["whole"], [r[:2] for r in V.CLUSTER_FAMILIES], "other")


def cluster_sink(d: Dialect, text: str | None = None) -> str:
    return f"COALESCE({d.first(text or _texts(d)['way'], V.CLUSTER_SINKS, None)}, CASE WHEN line IS NULL OR line = 0 THEN 'unknown sink' ELSE concat('L', CAST(line AS VARCHAR(12))) END)"


def firewall_family(d: Dialect, text: str | None = None) -> str:
    """On lower-cased text, so that a capital in a pattern never matches."""
    return d.first(text or _texts(d)["told_low"], V.FIREWALL_FAMILIES, None, "")


def bayes_class(d: Dialect, text: str | None = None) -> str:
    return d.first(text or _texts(d)["short_low"], V.BAYES_CLASSES, "default", "")


def dominance_class(d: Dialect, text: str | None = None) -> str:
    return d.first(text or _texts(d)["told_low"], V.DOMINANCE_CLASSES, "generic", "")


def proof_class(d: Dialect, text: str | None = None) -> str:
    return d.first(text or _texts(d)["short_low"], V.PROOF_CLASSES, "generic")


def minimizer_class(d: Dialect, text: str | None = None) -> str:
    return d.first(text or _texts(d)["told_low"], V.MINIMIZER_CLASSES, "generic", "")


def trust_families(d: Dialect, text: str | None = None) -> str:
    """All that match, joined."""
    text = text or _texts(d)["told_low"]
    return d.labels([(d.match(text, p), label) for p, labels in V.TRUST_FAMILIES for label in labels])


def priority(d: Dialect) -> str:
    """Place of a finding in a report: 0 first."""
    return """CASE WHEN type = 'bug' AND category = 'security' THEN 0 WHEN type = 'bug' AND severity = 'high' THEN 1 WHEN type = 'bug' AND severity = 'medium' THEN 2
      WHEN type = 'bug' THEN 3 WHEN type = 'risk' AND severity = 'high' THEN 4 WHEN type = 'risk' AND severity = 'medium' THEN 5 WHEN type = 'risk' THEN 6 ELSE 7 END"""


def classify(d: Dialect, issues: str) -> str:
    """Every finding with its class under each table."""
    made = {
        "root_family": root_family(d, "whole"), "root_sink": root_sink(d, "told"), "root_zone": root_zone(d, "way"), "cluster_family": cluster_family(d, "whole"), "cluster_sink": cluster_sink(d, "way"),
        "firewall_family": firewall_family(d, "told_low"), "bayes_class": bayes_class(d, "short_low"), "dominance_class": dominance_class(d, "told_low"), "proof_class": proof_class(d, "short_low"),
        "minimizer_class": minimizer_class(d, "told_low"), "trust_families": trust_families(d, "told_low"), "priority": priority(d),
        "protected": d.any("whole", [(p, "i") for p in V.PROTECTED]), "security_bug": d.any("told", [(p, "i") for p in V.SECURITY_BUGS]),
    }
    rows = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in _texts(d).items())} FROM {issues} i)"
    return f"SELECT doc_id, seq, {', '.join(f'{v} AS {k}' for k, v in made.items())} FROM {rows} t"


def file_language(d: Dialect) -> str:
    return d.first("code", V.PIPELINE_LANGUAGES, "javascript", "")


def file_frameworks(d: Dialect) -> str:
    found = {label: d.match("code", p, f) for label, p, f in V.PIPELINE_FRAMEWORKS}
    found["Express"] = f"({found['Express']} AND NOT {found['FastAPI']})"
    return d.labels([(c, label) for label, c in found.items()])


def router_frameworks(d: Dialect) -> list[tuple[str, str]]:
    return [(d.match("code", p), label) for p, label in V.ROUTER_FRAMEWORKS]


def describe_files(d: Dialect, files: str) -> str:
    """Language, frameworks and dangerous sinks of each file."""
    sinks = d.labels([(d.match("code", p), name) for name, p in V.DELTA_SINKS], "; ")
    return f"SELECT doc_id, {file_language(d)} AS language, {file_frameworks(d)} AS frameworks, {d.labels(router_frameworks(d))} AS router_frameworks, {sinks} AS sinks FROM {files}"
