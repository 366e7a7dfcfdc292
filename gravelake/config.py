"""Settings from the environment and experiment configurations from YAML."""

from __future__ import annotations

import os
import shutil
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

#: What is indexed of a script tree, and the retrieval defaults.
SCRIPT_DIRS = ("common", "events", "gui")
SCRIPT_SUFFIXES = (".txt", ".info", ".gui")
DEFAULT_ALPHA, EXACT_ALPHA, OVERFETCH = 0.5, 0.1, 10
EMBED_BATCH, EMBED_CALLS = 32, 20
#: The categories of scripts that an experiment indexes if it names none.
DEFAULT_CATEGORIES = ("decisions", "on_action", "scripted_triggers", "scripted_effects", "traits")
#: What the embedder is told of a query, by collection.
INSTRUCTIONS = {
    "game": "Find the script files (events, decisions, traits, interface definitions) that answer this question about modding the game.",
    "wiki": "Find the sections of the modding guides that answer this question.",
}


def env_str(name: str, default: str, env: Mapping[str, str] | None = None) -> str:
    """Blank counts as unset."""
    return ((env if env is not None else os.environ).get(name) or "").strip() or default


def env_int(name: str, default: int, env: Mapping[str, str] | None = None) -> int:
    return int(env_str(name, str(default), env))


def env_bool(name: str, default: bool = False, env: Mapping[str, str] | None = None) -> bool:
    value = (env if env is not None else os.environ).get(name)
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "on"}


def instruction(collection: str, env: Mapping[str, str] | None = None) -> str:
    """A variable that is set to blanks means none."""
    value = (env if env is not None else os.environ).get(f"EMBEDDING_QUERY_INSTRUCTION_{collection.upper()}")
    return INSTRUCTIONS[collection] if value is None else value.strip()


@dataclass(frozen=True)
class Settings:
    strategy: str = "ast"
    chunk_size: int = 256
    chunk_overlap: int = 0
    query_instruction_enabled: bool = False
    query_instruction_game: str = INSTRUCTIONS["game"]
    query_instruction_wiki: str = INSTRUCTIONS["wiki"]
    vocabulary: str | None = None  # of byte pairs, for token counts; else words and marks are counted
    validator: str | None = None
    game_path: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        return cls(
            strategy=env_str("CHUNKING_STRATEGY", "ast", env).lower(),
            chunk_size=env_int("CHUNK_SIZE", 256, env),
            chunk_overlap=env_int("CHUNK_OVERLAP", 0, env),
            query_instruction_enabled=env_bool("EMBEDDING_QUERY_INSTRUCTION_ENABLED", False, env),
            query_instruction_game=instruction("game", env),
            query_instruction_wiki=instruction("wiki", env),
            vocabulary=env_str("TOKEN_VOCABULARY", "", env) or None,
            validator=env_str("VALIDATOR_EXE", "", env) or shutil.which("script-validator"),
            game_path=env_str("GAME_PATH", "", env) or None,
        )


#: Where an experiment file has each field; of several places the first that is there counts.
_PLACES = {
    "name": ("name",),
    "description": ("description",),
    "common_categories": ("data.common_categories",),
    "include_events": ("data.include_events",),
    "include_gui": ("data.include_gui",),
    "wiki_files": ("data.wiki_files",),
    "game_files": ("data.game_files",),
    "game_files_txt": ("data.game_files_txt",),
    "vanilla_roots": ("data.roots.vanilla", "data.vanilla_roots"),
    "mod_roots": ("data.roots.mod", "data.mod_roots"),
    "chunking_strategy": ("chunking.strategy",),
    "chunk_size": ("chunking.chunk_size",),
    "chunk_overlap": ("chunking.chunk_overlap",),
    "alpha": ("retrieval.alpha",),
}


def _leaves(tree: Mapping, at: str = "") -> dict[str, object]:
    """Every value of nested mappings that is not null, by its dotted place; lists as tuples."""
    out: dict[str, object] = {}
    for key, value in tree.items():
        if isinstance(value, Mapping):
            out |= _leaves(value, f"{at}{key}.")
        elif value is not None:
            out[f"{at}{key}"] = tuple(value) if isinstance(value, list) else value
    return out


@dataclass(frozen=True)
class ExperimentConfig:
    name: str
    description: str = ""
    common_categories: tuple[str, ...] = DEFAULT_CATEGORIES
    include_events: bool = True
    include_gui: bool = False
    wiki_files: tuple[str, ...] | str = "all"
    game_files: tuple[str, ...] | None = None
    game_files_txt: str | None = None
    vanilla_roots: tuple[str, ...] = ()
    mod_roots: tuple[str, ...] = ()
    chunking_strategy: str = "sentence_splitter"
    chunk_size: int = 256
    chunk_overlap: int = 50
    alpha: float = DEFAULT_ALPHA

    def collection(self, kind: str) -> str:
        """Name of the experiment's own collection of scripts (`game`) or of Markdown (`wiki`)."""
        return f"exp_{self.name}_{kind}"

    @classmethod
    def from_yaml(cls, path: str | Path) -> ExperimentConfig:
        """A file with fields left out where the defaults hold; a list file beside it wins over an inline list."""
        import yaml

        from gravelake.sources.lists import read_list

        there = _leaves(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
        given = {f: next(there[x] for x in places if x in there) for f, places in _PLACES.items() if any(x in there for x in places)}
        if "name" not in given:
            raise KeyError("an experiment needs a name")
        if given.get("game_files_txt"):
            given["game_files"] = tuple(read_list(Path(path).parent / given["game_files_txt"]))
        return cls(**given)
