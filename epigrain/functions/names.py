"""Codec for the feature-name grammar ``<family>_<subject>_<stat>_<window>``.

Names look like ``CPP_<scale>_<stat>_<len>``, ``PeptDesc_<descriptor>_<stat>_<len>`` and
``sCPP_<scale>_<stat>_<len>``; a scale ending in ``inv`` is the inverted scale.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature families and the statistics each family carries.
CPP, DESCRIPTOR, SINGLE_CPP = "CPP", "PeptDesc", "sCPP"
CPP_STATS = ("Mean", "SD", "Med", "TrM", "MAD", "Skew", "Kurt", "SE", "IQR", "Q10", "Q90")
SINGLE_CPP_STATS = ("Max", "Min", "Mean", "SD", "Skew", "Kurt")
DESCRIPTOR_STATS = ("Min", "Max", "Mean", "Median")


class FeatureName(NamedTuple):
    family: str
    subject: str
    stat: str
    frag_len: int

    def encode(self) -> str:
        return f"{self.family}_{self.subject}_{self.stat}_{self.frag_len}"

    @classmethod
    def decode(cls, name: str) -> "FeatureName | None":
        parts = name.split("_")
        if len(parts) != 4 or parts[0] not in (CPP, DESCRIPTOR, SINGLE_CPP) or not parts[3].isdigit():
            return None
        return cls(parts[0], parts[1], parts[2], int(parts[3]))


def base_scale(scale_id: str) -> str:
    return scale_id[:-3] if scale_id.endswith("inv") else scale_id


def encode_column(family: str, subject: Column, stat: Column, frag_len: Column) -> Column:
    return F.concat_ws("_", F.lit(family), subject, stat, frag_len.cast("string"))


def decode_columns(name: Column) -> dict[str, Column]:
    parts = F.split(name, "_")
    return {
        "family": F.element_at(parts, 1),
        "subject": F.element_at(parts, 2),
        "stat": F.element_at(parts, 3),
        "frag_len": F.element_at(parts, 4).cast("int"),
    }
