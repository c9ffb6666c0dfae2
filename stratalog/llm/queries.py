"""Queries of the operators in this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from .op01_packing import op1_best_fit_packing
from .op02_language_id import op2_language_id
from .op03_decontamination import ORACLE as DECONTAMINATION_SQL
from .op03_decontamination import op3_decontamination
from .op04_pii import op4_pii
from .op05_license_scan import op5_license_scan
from .op06_jaccard_join import ORACLE as JACCARD_SQL
from .op06_jaccard_join import op6_jaccard_join
from .op07_sharding import SMALL, op7_sharding, sharding_small, sql
from .op08_token_store import op8_token_store
from .op09_suffix_dedup import op9_suffix_dedup
from .op10_spotsigs import op10_spotsigs

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_license_scan": op5_license_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_sharding": op7_sharding,
    "op8_token_store": op8_token_store,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_spotsigs": op10_spotsigs,
    "sharding_small": sharding_small,
}
ORACLES: dict[str, str] = {
    "op3_decontamination": DECONTAMINATION_SQL,
    "op6_jaccard_join": JACCARD_SQL,
    "op7_sharding": sql(),
    "sharding_small": sql(SMALL),
}
