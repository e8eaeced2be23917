"""Independent DuckDB SQL for the registered queries, used only for checking."""

from oracles import anomaly, diagnosis, launch, northstar, quality, segments


def all_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for module in (quality, northstar, diagnosis, launch, anomaly, segments):
        merged.update(module.SQL)
    return merged
