"""Run registered queries next to their SQL and compare the values."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype.kind == "f":
            pdf[c] = pdf[c].round(6) + 0.0
    return pdf.sort_values(list(pdf.columns), na_position="first").reset_index(drop=True)


def difference(got, want):
    """None if equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    kinds = {c: (got[c].dtype, want[c].dtype) for c in got.columns
             if got[c].dtype != want[c].dtype and len(got) and not got[c].isna().any()}
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        x, y = a[c].to_numpy(), b[c].to_numpy()
        if x.dtype.kind in "fiub" and y.dtype.kind in "fiub":
            same = np.isclose(x.astype(float), y.astype(float), rtol=0, atol=1.5e-6, equal_nan=True)
        else:
            same = np.array([p == q or (p is None and q is None) for p, q in zip(x, y)], dtype=bool)
        if not same.all():
            i = int(np.flatnonzero(~same)[0])
            return f"values of {c}: {x[i]!r} / {y[i]!r} ({int((~same).sum())} differ)"
    return f"types {kinds}" if kinds else None
