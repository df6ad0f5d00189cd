from strandline.sources.corpus import Corpus
from strandline.sources.readers import ExportedLayout, check_columns, open_exported, read_table
from strandline.sources.workspace import Workspace, shared_folder

__all__ = [
    "Corpus",
    "ExportedLayout",
    "Workspace",
    "check_columns",
    "open_exported",
    "read_table",
    "shared_folder",
]
