"""Physico-chemical descriptors of every peptide window, summarised per peptide.

Six descriptors follow from closed formulas and the small published tables below.  The vector families
(BLOSUM indices, Cruciani properties, FASGAI, Kidera factors, MS-WHIM, ProtFP, VHSE, Z-scales) are means of residue
values and come from a caller's table (descriptor, aa, value); the instability index comes from a
table of dipeptide weights (pair, value).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS
from ..functions.names import DESCRIPTOR, DESCRIPTOR_STATS, FeatureName
from ..session import spread
from .contact_profile import encode
from .sequences import peptide_basic

# Descriptor names in their conventional order.
DESCRIPTORS = (
    "AliphaticIndex",
    *[f"BLOSUM{i}" for i in range(1, 11)],
    "Boman",
    "Charge",
    *[f"PP{i}" for i in range(1, 4)],
    *[f"F{i}" for i in range(1, 7)],
    "HydrophobicMoment",
    "Hydrophobicity",
    "Instability",
    *[f"KF{i}" for i in range(1, 11)],
    *[f"MSWHIM{i}" for i in range(1, 4)],
    "pI",
    *[f"ProtFP{i}" for i in range(1, 9)],
    *[f"VHSE{i}" for i in range(1, 9)],
    *[f"Z{i}" for i in range(1, 6)],
)
CLOSED_FORM = ("AliphaticIndex", "Boman", "Charge", "HydrophobicMoment", "Hydrophobicity", "pI")

# Fixed values, in alphabetical residue order: hydropathy (Kyte and Doolittle, 1982), consensus
# hydrophobicity (Eisenberg et al., 1984), and side-chain transfer energies used by the Boman index
# (Radzicka and Wolfenden, 1988).
HYDROPATHY = dict(A=1.8, C=2.5, D=-3.5, E=-3.5, F=2.8, G=-0.4, H=-3.2, I=4.5, K=-3.9, L=3.8, M=1.9, N=-3.5, P=-1.6,
                  Q=-3.5, R=-4.5, S=-0.8, T=-0.7, V=4.2, W=-0.9, Y=-1.3)
EISENBERG = dict(A=0.62, C=0.29, D=-0.90, E=-0.74, F=1.19, G=0.48, H=-0.40, I=1.38, K=-1.50, L=1.06, M=0.64, N=-0.78,
                 P=0.12, Q=-0.85, R=-2.53, S=-0.18, T=-0.05, V=1.08, W=0.81, Y=0.26)
TRANSFER = dict(A=1.81, C=1.28, D=-8.72, E=-6.81, F=2.98, G=0.94, H=-4.66, I=4.92, K=-5.55, L=4.92, M=2.35, N=-6.64,
                P=0.0, Q=-5.54, R=-14.92, S=-3.40, T=-2.57, V=4.04, W=2.33, Y=-0.14)
# Aliphatic index weights (Ikai, 1980) and acid dissociation constants of two common scales.
ALIPHATIC = dict(A=1.0, V=2.9, I=3.9, L=3.9)
PK_LEHNINGER = dict(cterm=2.34, nterm=9.69, C=8.18, D=3.65, E=4.25, H=6.00, K=10.53, R=12.48, Y=10.07)
PK_EMBOSS = dict(cterm=3.6, nterm=8.6, C=8.5, D=3.9, E=4.1, H=6.5, K=10.8, R=12.5, Y=10.1)
ACIDIC, BASIC = "CDEY", "HKR"
CHARGE_PH = 7.0
MAX_TABLES = 1_000
MOMENT_ANGLE, MOMENT_WINDOW = 100.0, 11


def _vector(table: dict[str, float]) -> np.ndarray:
    return np.array([table.get(a, 0.0) for a in AMINO_ACIDS])


def _net_charge(counts: np.ndarray, ph, pk: dict[str, float]) -> np.ndarray:
    charge = 1.0 / (1.0 + 10.0 ** (ph - pk["nterm"])) - 1.0 / (1.0 + 10.0 ** (pk["cterm"] - ph))
    for a in BASIC:
        charge = charge + counts[..., AMINO_ACIDS.index(a)] / (1.0 + 10.0 ** (ph - pk[a]))
    for a in ACIDIC:
        charge = charge - counts[..., AMINO_ACIDS.index(a)] / (1.0 + 10.0 ** (pk[a] - ph))
    return charge


def _isoelectric_point(counts: np.ndarray) -> np.ndarray:
    low, high = np.zeros(counts.shape[:-1]), np.full(counts.shape[:-1], 14.0)
    for _ in range(50):
        mid = (low + high) / 2
        positive = _net_charge(counts, mid, PK_EMBOSS) > 0
        low, high = np.where(positive, mid, low), np.where(positive, high, mid)
    return (low + high) / 2


def _hydrophobic_moment(windows: np.ndarray) -> np.ndarray:
    span = min(windows.shape[-1], MOMENT_WINDOW)
    values = np.lib.stride_tricks.sliding_window_view(_vector(EISENBERG)[windows], span, axis=-1)
    angle = np.deg2rad(MOMENT_ANGLE) * np.arange(1, span + 1)
    moment = np.hypot((values * np.cos(angle)).sum(-1), (values * np.sin(angle)).sum(-1)) / span
    return moment.max(axis=-1)


def _window_sums(values: np.ndarray, width: int) -> np.ndarray:
    """Sums over every window along axis 1, from one cumulative sum."""
    total = np.cumsum(values, axis=1)
    total = np.concatenate([np.zeros_like(total[:, :1]), total], axis=1)
    return total[:, width:] - total[:, :-width]


def window_descriptors(
    codes: np.ndarray, width: int, names: Sequence[str], residues: dict[str, np.ndarray], dipeptides: np.ndarray | None
) -> np.ndarray:
    """Descriptor values of all windows of equally long peptides: (n, L) codes -> (n, windows, descriptor)."""
    means = {
        "AliphaticIndex": _vector(ALIPHATIC) * 100,
        "Boman": -_vector(TRANSFER),
        "Hydrophobicity": _vector(HYDROPATHY),
        **residues,
    }
    averaged = [d for d in names if d in means]
    out = np.empty((len(codes), codes.shape[1] - width + 1, len(names)))
    if averaged:
        table = np.stack([means[d] for d in averaged], axis=1)
        out[:, :, [names.index(d) for d in averaged]] = _window_sums(table[codes], width) / width
    if "Charge" in names or "pI" in names:
        counts = _window_sums(np.eye(20)[codes], width)
    for k, name in enumerate(names):
        if name == "Charge":
            out[:, :, k] = _net_charge(counts, CHARGE_PH, PK_LEHNINGER)
        elif name == "pI":
            out[:, :, k] = _isoelectric_point(counts)
        elif name == "HydrophobicMoment":
            out[:, :, k] = _hydrophobic_moment(np.lib.stride_tricks.sliding_window_view(codes, width, axis=1))
        elif name == "Instability":
            steps = dipeptides[codes[:, :-1], codes[:, 1:]]
            out[:, :, k] = _window_sums(steps, width - 1) * 10.0 / width
    return out


def _tables(residue_table: DataFrame | None, dipeptide_table: DataFrame | None):
    residues: dict[str, np.ndarray] = {}
    if residue_table is not None:
        rows = residue_table.select("descriptor", "aa", "value").limit(20 * MAX_TABLES + 1).collect()
        if len(rows) > 20 * MAX_TABLES:
            raise ValueError("too many residue tables")
        for name, aa, value in rows:
            residues.setdefault(name, np.zeros(20))[AMINO_ACIDS.index(aa)] = value
    dipeptides = None
    if dipeptide_table is not None:
        dipeptides = np.zeros((20, 20))
        rows = dipeptide_table.select("pair", "value").limit(401).collect()
        if len(rows) > 400:
            raise ValueError("a dipeptide table has at most 400 rows")
        for pair, value in rows:
            dipeptides[AMINO_ACIDS.index(pair[0]), AMINO_ACIDS.index(pair[1])] = value
    return residues, dipeptides


def available_descriptors(residues: dict, dipeptides) -> list[str]:
    known = set(residues) | set(CLOSED_FORM) | ({"Instability"} if dipeptides is not None else set())
    ordered = [d for d in DESCRIPTORS if d in known]
    return ordered + sorted(set(residues) - set(DESCRIPTORS))


def peptdesc_features(
    peptides: DataFrame,
    frag_lens: Iterable[int] = range(3, 9),
    residue_table: DataFrame | None = None,
    dipeptide_table: DataFrame | None = None,
    feature_set: Sequence[str] | None = None,
) -> DataFrame:
    """Wide table: peptide, basic columns, ``PeptDesc_<descriptor>_<stat>_<len>``.

    One Arrow-batched map over the peptides; a feature list prunes descriptors and lengths before anything
    is computed, and skips the map when it names no descriptor.
    """
    wanted = None if feature_set is None else set(feature_set)
    residues, dipeptides = _tables(residue_table, dipeptide_table)
    names = available_descriptors(residues, dipeptides)
    grid = [
        FeatureName(DESCRIPTOR, d, s, n) for n in sorted(set(frag_lens)) for d in names for s in DESCRIPTOR_STATS
    ]
    if wanted is not None:
        decoded = [FeatureName.decode(f) for f in feature_set]
        grid = sorted(
            {d for d in decoded if d is not None and d.family == DESCRIPTOR and d.subject in names},
            key=lambda d: (d.frag_len, names.index(d.subject), DESCRIPTOR_STATS.index(d.stat)),
        )
    basic = peptide_basic(peptides.select("peptide"))
    if grid:
        out = _with_descriptors(peptides, basic, grid, residues, dipeptides)
    else:
        out = basic
    if wanted is not None:
        out = out.select("peptide", *[F.col(c) for c in out.columns if c in wanted])
    return out


def _with_descriptors(peptides, basic, grid, residues, dipeptides) -> DataFrame:
    lens = sorted({g.frag_len for g in grid})
    by_len = {n: list(dict.fromkeys(g.subject for g in grid if g.frag_len == n)) for n in lens}
    slots = {
        n: [
            (i, by_len[n].index(g.subject), DESCRIPTOR_STATS.index(g.stat)) for i, g in enumerate(grid) if g.frag_len == n
        ]
        for n in lens
    }

    def run(batches):
        for pdf in batches:
            sequences = pdf["peptide"]
            values = np.full((len(sequences), len(grid)), np.nan)
            for length, rows in sequences.groupby(sequences.str.len()).indices.items():
                codes = np.stack([encode(s) for s in sequences.to_numpy()[rows]])
                for n in lens:
                    if n > length:
                        continue
                    d = window_descriptors(codes, n, by_len[n], residues, dipeptides)
                    stats = (d.min(axis=1), d.max(axis=1), d.mean(axis=1), np.median(d, axis=1))
                    for i, k, s in slots[n]:
                        values[rows, i] = stats[s][:, k]
            yield pdf.assign(values=list(values))

    schema = f"{basic.schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, values array<double>"
    value = F.col("values")
    return spread(basic, "peptide").mapInPandas(run, schema).select(
        *basic.columns, *[F.when(~F.isnan(value[i]), value[i]).alias(g.encode()) for i, g in enumerate(grid)]
    )


def features(descriptor_table: DataFrame, cpp_table: DataFrame) -> DataFrame:
    """Full feature table: descriptors joined to profiles, keyed by (library, frag_depth) columns."""
    return descriptor_table.join(cpp_table, "peptide")


def split_features(table: DataFrame, keys: Iterable[tuple[str, int]]) -> dict[tuple[str, str], DataFrame]:
    """Per-(library, depth) views of a feature table without the key columns."""
    return {
        (library, str(depth)): table.where((F.col("library") == library) & (F.col("frag_depth") == depth)).drop(
            "library", "frag_depth"
        )
        for library, depth in keys
    }
