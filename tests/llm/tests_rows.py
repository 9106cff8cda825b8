"""Rows of a pandas frame in a form that doesn't depend on the engine."""

import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return ""
        v = v.item() if hasattr(v, "item") else v
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
