"""All queries of this subpackage, with their SQL where SQL can express them."""

from importlib import import_module

MODULES = ("q_simhash", "q_records", "q_substring", "q_pieces", "q_templates", "q_toxicity", "q_rollup", "q_licences", "q_neighbours", "q_pitman_yor", "q_resample", "q_audit", "q_bpe")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
