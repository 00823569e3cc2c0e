"""Sources (inputs, fixture bindings) and sinks (embedding tables, texts)."""

from .inputs import Inputs, load_fixture, load_inputs, relevant_only
from .sinks import read_embedding_table, read_texts, save_config, write_embedding_table, write_texts

__all__ = [
    "Inputs", "load_inputs", "load_fixture", "relevant_only",
    "write_embedding_table", "read_embedding_table", "write_texts", "read_texts", "save_config",
]
