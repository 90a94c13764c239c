"""Column roles and option checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.sources.csv_blocks import POSITION

# The option names an experiment must carry, by section.
REQUIRED_OPTIONS = {
    "data": ["file_path", "text_column", "label_column", "author_column"],
    "descriptive_statistics": [
        "enabled",
        "plot_label_distribution",
        "word_count_per_label",
        "get_author_info",
        "get_top_n_words_per_label",
    ],
    "modeling": ["enabled", "model_type", "hyperparameters"],
    "preprocessing": ["number_of_folds", "get_descriptive_statistics_after_preprocessing"],
    "masking": ["enabled", "masking_strategy"],
}


@dataclass(frozen=True)
class ColumnRoles:
    """Which source columns play which part; ``doc_id`` and ``author`` may be absent."""

    text: str
    label: str
    author: str | None = None
    doc_id: str | None = None

    @classmethod
    def from_options(cls, options: Mapping) -> ColumnRoles:
        data = options["data"]
        return cls(
            text=data["text_column"],
            label=data["label_column"],
            author=data["author_column"],
            doc_id=data.get("id_column"),
        )

    def bind(self, df: DataFrame, *extra: str) -> DataFrame:
        """One projection to the canonical names, so unused columns are pruned at the scan.

        Without an id column the rows' positions in file order are the ids, where the table was read with
        them (``csv_blocks``). Otherwise ids follow the read order inside each input split: write the
        result once (``store.write_prepared``) before relying on them in more than one job.
        """
        named = {"doc_id": self.doc_id, "author": self.author, "label": self.label, "text": self.text}
        require_columns(df, [source for source in named.values() if source] + list(extra))
        chosen = [F.col(source).alias(name) for name, source in named.items() if source]
        if self.doc_id is None:
            known = POSITION in df.columns
            chosen.insert(0, (F.col(POSITION) if known else F.monotonically_increasing_id()).alias("doc_id"))
        return df.select(*chosen, *extra)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail before any job starts when a column is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")
    return df


def check_options(options: Mapping) -> None:
    """Fail with the name of the first missing option."""
    for section, names in REQUIRED_OPTIONS.items():
        if section not in options:
            raise ValueError(f"missing option: {section}")
        for name in names:
            if name not in options[section]:
                raise ValueError(f"missing option: {section}.{name}")
    if "load_dataset" not in options:
        raise ValueError("missing option: load_dataset")
