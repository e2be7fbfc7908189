"""Where region sets and baselines are found: an explicit path, else (unless skipped) the assay's, else the genome's, else none."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Aliases of the two genomes.
GENOMES = {"hg19": "hg19", "grch37": "hg19", "hg38": "hg38", "grch38": "hg38"}
KINDS = ("bins", "arms", "anchors", "elements", "regions", "tfbs", "atac", "genes", "targets", "blacklist", "gc_reference", "pon")


@dataclass
class Assets:
    """Paths by (kind, genome, assay); roots are any folders or stores that Spark reads. The environment variable overrides the root."""

    genome: str = "hg19"
    root: str | None = None
    known: dict[tuple[str, str, str | None], str] = field(default_factory=dict)
    variable: str = "PLASMASPARK_ASSETS"

    def __post_init__(self):
        if self.genome.lower() not in GENOMES:
            raise ValueError(f"unknown genome: {self.genome}")
        self.genome = GENOMES[self.genome.lower()]
        self.root = os.environ.get(self.variable) or self.root

    def add(self, kind: str, path: str, assay: str | None = None) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        self.known[kind, self.genome, assay] = path

    def resolve(self, kind: str, explicit: str | None = None, assay: str | None = None, skip: bool = False) -> tuple[str | None, str]:
        """(path, where it comes from)."""
        if explicit:
            return explicit, "explicit"
        if skip:
            return None, "skipped"
        for key, source in (((kind, self.genome, assay), "assay"), ((kind, self.genome, None), "genome")):
            if path := self.known.get(key):
                return (f"{self.root.rstrip('/')}/{path}" if self.root and "/" not in path[:1] and "://" not in path else path), source
        return None, "none"
