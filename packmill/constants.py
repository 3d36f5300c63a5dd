"""Fixed values.  They decide which files are packed and how the document reads,
so they are stated once, as plain text, and everything else refers to them."""

# Directory names (and a few file names) that are never entered.
# Compared with lower-cased path components; the two entries that are not all
# lower case therefore never match, which is kept on purpose.
IGNORED_NAMES = (
    ".git", ".github", ".gitlab", ".svn", ".hg", "node_modules",
    "__pycache__", ".venv", "venv", "env", ".env", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".egg-info", "build", "dist",
    ".idea", ".vscode", ".settings",
    ".DS_Store", "Thumbs.db", "desktop.ini",
)

# Extensions of files taken to be binary.
IGNORED_EXTENSIONS = (
    ".pyc", ".pyo", ".pyd", ".class", ".o", ".obj", ".dll", ".so", ".dylib",
    ".a", ".lib", ".exe", ".msi", ".apk", ".dmg", ".iso", ".img", ".bin",
    ".dat", ".wasm",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".rar", ".7z", ".tgz", ".jar",
    ".war", ".ear",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".tiff", ".svg",
    ".mp3", ".wav", ".ogg", ".flac", ".mp4", ".mkv", ".avi", ".mov", ".webm",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".db", ".sqlite", ".sqlite3", ".pdf", ".epub", ".pkl", ".pickle",
    ".joblib", ".npy", ".npz", ".parquet", ".onnx", ".pt", ".h5", ".hdf5",
    ".docx", ".xlsx", ".pptx", ".doc", ".xls", ".ppt",
)

# Names ignored on plain files.
IGNORED_FILE_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini", ".env")

# Names with a leading dot that are packed all the same.
ALLOWED_HIDDEN_FILES = (
    ".gitignore", ".gitattributes", ".gitmodules",
    ".env.example", ".env.template",
    ".pylintrc", ".flake8", ".coveragerc",
    ".dockerignore", ".editorconfig",
    ".pre-commit-config.yaml", ".python-version",
    ".readthedocs.yaml", ".readthedocs.yml", ".codecov.yml",
)

# Ignore-file names.  Rules of the second override the first's.
VCS_IGNORE_FILE = ".gitignore"
TOOL_IGNORE_FILE = ".pyaiignore"

# Fixed value: a leftover document of this name at a project's root is dropped.
LEFTOVER_NAME = "ai_context.txt"

# Extension -> language tag of a Markdown fence.
LANGUAGES = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "tsx",
    ".json": "json", ".jsonc": "jsonc",
    ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".ini": "ini",
    ".cfg": "ini", ".xml": "xml", ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "scss", ".less": "less",
    ".md": "markdown", ".markdown": "markdown",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".sql": "sql", ".rs": "rust", ".go": "go",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".r": "r", ".lua": "lua", ".pl": "perl",
    ".dockerfile": "dockerfile", ".makefile": "makefile",
    ".txt": "text", ".log": "text", ".csv": "csv",
}

# Document layout.
FORMATS = ("text", "markdown")
RULER = "=" * 80
BRANCH, LAST_BRANCH = "├── ", "└── "
BAR, BLANK = "│   ", "    "

# Notes and skip reasons.
NOTE_OUTSIDE = "symlink outside project root — not followed, not packed"
NOTE_REPEATED = "cyclic or duplicate link — already traversed, not followed"
NOTE_DIR_LINK = "directory symlink — not followed"
UNREADABLE_LINK = "<unreadable link>"
REASON_BINARY = "binary file"
REASON_BAD_BOM = "encoding error (invalid BOM-marked content)"
REASON_PERMISSION = "permission denied"

# Measures.
BINARY_WINDOW = 8192
CHARS_PER_TOKEN = 4
TOKEN_ENCODING = "cl100k_base"
METHOD_EXACT = "cl100k_base (tiktoken)"
METHOD_HEURISTIC = "heuristic (~4 chars/token)"
METHOD_OFF = "disabled"
SIZE_UNITS = {"B": 1, "KB": 1024, "MB": 1024 ** 2, "GB": 1024 ** 3}
