"""Settings from the environment and a .env file: PERGAMO_DATA_DIR, PERGAMO_EMBEDDING_MODEL."""

from __future__ import annotations

import os
from dataclasses import dataclass

PREFIX = "PERGAMO_"
# Fixed value: the multilingual model of 384 dimensions that vectors are made with unless another is named.
DEFAULT_MODEL = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"


@dataclass(frozen=True)
class Settings:
    """Where the tables live (a path or a URL that Spark reads) and the model's name."""

    data_dir: str
    embedding_model: str = DEFAULT_MODEL

    @property
    def uploads(self) -> str:
        return f"{self.data_dir}/tomos"

    @property
    def tables(self) -> str:
        return f"{self.data_dir}/tablas"


def _from_file(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines, comments and quotes around values don't count; a missing file has none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def settings(root: str = ".", env: dict[str, str] | None = None) -> Settings:
    """The environment goes before root/.env, unknown names are ignored, a relative folder is taken from root."""
    found = {**_from_file(os.path.join(root, ".env")), **(os.environ if env is None else env)}
    folder = found.get(f"{PREFIX}DATA_DIR", "data")
    anchored = folder if os.path.isabs(folder) or "://" in folder else os.path.abspath(os.path.join(root, folder))
    return Settings(anchored.rstrip("/"), found.get(f"{PREFIX}EMBEDDING_MODEL", DEFAULT_MODEL))
