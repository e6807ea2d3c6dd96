"""scorelake: evaluation of generated answers and preparation of their data, on Spark DataFrames.

Names below are loaded when they are first asked for, so that a worker that imports one module doesn't load all.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_WHERE = {
    "run_evaluation": "operators.evaluation", "RunResult": "operators.evaluation", "Store": "operators.evaluation", "JsonStore": "operators.evaluation", "TableStore": "operators.evaluation", "Evaluator": "operators.evaluation", "PatternEvaluator": "operators.evaluation",
    "MoleculeEvaluator": "operators.evaluation", "SqlEvaluator": "operators.evaluation", "nested_results": "operators.evaluation", "bootstrap_ci": "operators.statistics", "LRUCache": "operators.lru",
    "sql_dataset": "operators.datasets", "sql_instances": "operators.datasets", "sql_match": "operators.sql_match", "sql_trees": "operators.sql_match", "sql_components": "operators.sql_match",
    "exec_match_on_spark": "operators.sql_match", "sql_match_on_spark": "operators.sql_match", "judge": "operators.sql_match", "orphan_references": "operators.references", "orphan_report": "operators.references", "patterns_from_csv": "sources.files", "patterns_from_list": "sources.files",
    "molecules_from_smiles": "sources.files", "molecules_from_list": "sources.files", "chat_messages": "functions.prompts", "serialize_schema": "functions.prompts", "user_message": "functions.prompts",
    "score_patterns": "functions.regexes", "molecule_scores": "functions.smiles", "read_sql": "functions.sql.reader", "foreign_key_map": "functions.sql.normal", "foreign_key_maps": "functions.sql.normal",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(importlib.import_module(f"scorelake.{_WHERE[name]}"), name)
    raise AttributeError(name)
