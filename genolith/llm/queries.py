"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
import importlib

from .shared import ship

#: query: (module, name of its SQL if any)
_MODULES = {
    "op1_personal_data": ("pii", None),
    "op2_decontaminate": ("decontamination", "OP2_SQL"),
    "op3_minimax_shards": ("sharding", None),
    "op4_dated_lists": ("urlfilters", "OP4_SQL"),
    "op5_linked_secrets": ("secrets", None),
    "op6_license_notices": ("licenses", None),
    "op7_near_duplicates": ("neardup", "OP7_SQL"),
    "op8_quality_rules": ("quality", None),
    "op9_token_files": ("tokenfiles", None),
    "op10_pack": ("packing", None),
}


def _query(name: str, module: str):
    own = getattr(importlib.import_module(f"{__package__}.{module}"), name)

    @functools.wraps(own)
    def run(spark, sf_dir: str):
        ship(spark)
        return own(spark, sf_dir)

    return run


QUERIES = {name: _query(name, module) for name, (module, _) in _MODULES.items()}
ORACLE_SQL = {name: getattr(importlib.import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in _MODULES.items() if sql}
