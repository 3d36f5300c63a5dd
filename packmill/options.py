"""Options of a pack."""

from dataclasses import dataclass

from packmill.functions.render import check_format
from packmill.functions.text import parse_size

TOKEN_COUNTING = ("heuristic", "exact", "off")


@dataclass(frozen=True)
class PackOptions:
    """`max_file_size` takes bytes or a size such as '512KB'; `generated_at` is the
    header's time stamp, the current time if missing; `output_path` is the document's
    own path inside the project, a file or a folder, never packed; `extra_filter` is a SQL
    condition over the manifest's columns that files and links must meet (NULL: not met);
    directories stay in the tree, for these there are `exclude_patterns`."""

    output_format: str = "text"
    include_tree: bool = True
    max_file_size: int | str | None = None
    exclude_patterns: tuple[str, ...] = ()
    respect_ignore_files: bool = True
    token_counting: str = "heuristic"
    generated_at: str | None = None
    output_path: str | None = None
    extra_filter: str | None = None

    def __post_init__(self):
        check_format(self.output_format)
        if self.token_counting not in TOKEN_COUNTING:
            raise ValueError(f"unknown token counting {self.token_counting!r}")
        if isinstance(self.max_file_size, str):
            object.__setattr__(self, "max_file_size", parse_size(self.max_file_size))
        object.__setattr__(self, "exclude_patterns", tuple(self.exclude_patterns))
