"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the behaviour being
reproduced (ignore lists, extension lists, priority patterns, language and
type maps, the model price table and its aliases, display strings).  They are
listed plainly and in their natural order; nothing here is logic.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Default ignore patterns, in order (custom patterns are appended after these).
DEFAULT_IGNORE = [
    "node_modules", ".git", "dist", "build", ".next", "__pycache__", ".venv",
    "venv", ".env", ".DS_Store", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "*.log", "*.map", "*.min.js", "*.min.css", "coverage",
    ".nyc_output", ".cache", ".idea", ".vscode", "*.pyc", "*.pyo", "Thumbs.db",
]

# Binary extensions that are never packed (file or directory name).
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "ico", "webp", "svg", "bmp", "tiff",
    "mp3", "mp4", "wav", "avi", "mov", "webm", "flv", "mkv",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "tar", "gz", "rar", "7z", "bz2", "xz",
    "exe", "dll", "so", "dylib", "bin",
    "woff", "woff2", "ttf", "eot", "otf",
    "pyc", "pyo", "class", "o", "obj",
    "sqlite", "db", "sqlite3",
    "jar", "war", "ear",
]

# Importance patterns, most important first; the index is the priority.
# (pattern, case_insensitive), tested against the base name or the path.
PRIORITY_PATTERNS = [
    (r"^readme", True),
    (r"^package\.json$", False),
    (r"^index\.(js|ts|jsx|tsx)$", False),
    (r"^main\.(js|ts|py|go|rs)$", False),
    (r"^app\.(js|ts|jsx|tsx|py)$", False),
    (r"^server\.(js|ts)$", False),
    (r"^config", True),
    (r"^\.env\.example$", False),
    (r"src/index", False),
    (r"src/main", False),
    (r"src/app", False),
]
# Fallback priorities by substring of the path, tested in this order.
PRIORITY_FALLBACK = [
    (["src/"], 100),
    (["lib/"], 101),
    (["test/", "tests/"], 200),
    (["doc/", "docs/"], 201),
]
PRIORITY_DEFAULT = 150
PRESERVE_PRIORITY = 50          # files with priority <= this are never truncated

# Fence language by the text after the last dot of the path.
LANGUAGE_MAP = {
    "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx",
    "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp",
    "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
    "sh": "bash", "bash": "bash", "zsh": "zsh", "fish": "fish",
    "ps1": "powershell", "sql": "sql", "css": "css", "scss": "scss",
    "less": "less", "html": "html", "xml": "xml", "json": "json",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini",
    "md": "markdown", "txt": "text", "vue": "vue", "svelte": "svelte",
}

# File type used by the by_type split strategy.
TYPE_MAP = {
    "js": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "typescript", "py": "python", "rb": "ruby", "go": "go",
    "rs": "rust", "java": "java", "c": "c", "cpp": "cpp", "h": "c",
    "hpp": "cpp", "css": "styles", "scss": "styles", "less": "styles",
    "html": "markup", "xml": "markup", "json": "config", "yaml": "config",
    "yml": "config", "toml": "config", "md": "docs", "txt": "docs",
}
TYPE_DEFAULT = "other"

# Extensions whose comments are stripped, by comment syntax.
C_LIKE_EXTENSIONS = ["js", "ts", "jsx", "tsx", "java", "c", "cpp", "cs", "go", "rs"]
HASH_LIKE_EXTENSIONS = ["py", "rb", "sh", "bash", "zsh", "yaml", "yml"]

# Strategy names reported by the optimizer.
STRATEGY_REMOVE_COMMENTS = "remove_comments"
STRATEGY_REMOVE_EMPTY_LINES = "remove_empty_lines"
STRATEGY_TRUNCATE_LARGE = "truncate_large"
STRATEGY_MINIFY = "minify"
TRUNCATION_MARKER = "\n// ... truncated ..."

# Split strategies and defaults.
SPLIT_STRATEGIES = ["by_tokens", "by_files", "by_directory", "by_type"]
DEFAULT_FILES_PER_CHUNK = 20
DEFAULT_OVERLAP_FILES = 2
UNKNOWN_MODEL_CHUNK_TOKENS = 50000
UNKNOWN_MODEL_TARGET_TOKENS = 100000
LARGE_FILE_BYTES = 10000

# Size limits.
DEFAULT_MAX_FILE_SIZE = 100 * 1024           # library and most commands
PACK_COMMAND_MAX_FILE_SIZE = 1000 * 1024     # the pack command's default

# Model table: name, context window, USD per 1M input / output tokens,
# tokenizer, provider.  Declaration order is the tie-break of model sorts.
MODELS = [
    ("gpt-5.4", 400000, 2.50, 15.00, "cl100k_base", "openai"),
    ("gpt-5.4-mini", 400000, 0.75, 4.50, "cl100k_base", "openai"),
    ("gpt-5.4-nano", 400000, 0.20, 1.25, "cl100k_base", "openai"),
    ("gpt-5.2", 400000, 1.25, 10.00, "cl100k_base", "openai"),
    ("gpt-5.1", 400000, 1.25, 10.00, "cl100k_base", "openai"),
    ("gpt-5", 400000, 1.25, 10.00, "cl100k_base", "openai"),
    ("gpt-5-mini", 400000, 0.25, 2.00, "cl100k_base", "openai"),
    ("gpt-5-nano", 400000, 0.05, 0.40, "cl100k_base", "openai"),
    ("gpt-4.1", 1000000, 2.00, 8.00, "cl100k_base", "openai"),
    ("gpt-4.1-mini", 1000000, 0.40, 1.60, "cl100k_base", "openai"),
    ("gpt-4.1-nano", 1000000, 0.10, 0.40, "cl100k_base", "openai"),
    ("gpt-4o", 128000, 2.50, 10.00, "cl100k_base", "openai"),
    ("gpt-4o-mini", 128000, 0.15, 0.60, "cl100k_base", "openai"),
    ("o3", 200000, 2.00, 8.00, "cl100k_base", "openai"),
    ("o3-mini", 200000, 1.10, 4.40, "cl100k_base", "openai"),
    ("o4-mini", 200000, 1.10, 4.40, "cl100k_base", "openai"),
    ("claude-opus-4-7", 1000000, 5.00, 25.00, "cl100k_base", "anthropic"),
    ("claude-opus-4-6", 200000, 5.00, 25.00, "cl100k_base", "anthropic"),
    ("claude-sonnet-4-6", 200000, 3.00, 15.00, "cl100k_base", "anthropic"),
    ("claude-haiku-4-5", 200000, 1.00, 5.00, "cl100k_base", "anthropic"),
    ("claude-3.5-sonnet", 200000, 3.00, 15.00, "cl100k_base", "anthropic"),
    ("claude-3.5-haiku", 200000, 0.80, 4.00, "cl100k_base", "anthropic"),
    ("gemini-3.1-pro", 2000000, 2.00, 12.00, "cl100k_base", "google"),
    ("gemini-3-pro", 2000000, 2.00, 12.00, "cl100k_base", "google"),
    ("gemini-3-flash", 1000000, 0.50, 3.00, "cl100k_base", "google"),
    ("gemini-3.1-flash-lite", 1000000, 0.25, 1.50, "cl100k_base", "google"),
    ("gemini-2.5-pro", 2000000, 1.25, 10.00, "cl100k_base", "google"),
    ("gemini-2.5-flash", 1000000, 0.30, 2.50, "cl100k_base", "google"),
    ("llama-4-scout", 10000000, 0.15, 0.60, "cl100k_base", "meta"),
    ("llama-4-maverick", 1000000, 0.15, 0.60, "cl100k_base", "meta"),
    ("llama-3.3-70b", 128000, 0.40, 0.40, "cl100k_base", "meta"),
    ("mistral-large-3", 128000, 2.00, 6.00, "cl100k_base", "mistral"),
    ("mistral-medium-3", 128000, 1.00, 3.00, "cl100k_base", "mistral"),
    ("mistral-small-4", 128000, 0.15, 0.60, "cl100k_base", "mistral"),
    ("magistral-medium", 40000, 2.00, 5.00, "cl100k_base", "mistral"),
    ("magistral-small-1.2", 40000, 0.50, 1.50, "cl100k_base", "mistral"),
    ("codestral", 32000, 0.20, 0.60, "cl100k_base", "mistral"),
    ("grok-4", 256000, 3.00, 15.00, "cl100k_base", "xai"),
    ("grok-4.1-fast", 2000000, 0.20, 0.50, "cl100k_base", "xai"),
    ("deepseek-v3.2", 128000, 0.28, 0.42, "cl100k_base", "deepseek"),
    ("deepseek-r2", 128000, 0.70, 2.50, "cl100k_base", "deepseek"),
    ("qwen3-max", 262000, 0.78, 3.90, "cl100k_base", "alibaba"),
    ("qwen3.5-plus", 1000000, 0.26, 1.56, "cl100k_base", "alibaba"),
    ("command-a", 256000, 2.50, 10.00, "cl100k_base", "cohere"),
    ("command-r-plus", 128000, 2.50, 10.00, "cl100k_base", "cohere"),
    ("command-r", 128000, 0.15, 0.60, "cl100k_base", "cohere"),
    ("command-r7b", 128000, 0.0375, 0.15, "cl100k_base", "cohere"),
]

# Short names resolved to a model.
MODEL_ALIASES = [
    ("gpt", "gpt-5.4"),
    ("openai", "gpt-5.4"),
    ("gpt-5-turbo", "gpt-5"),
    ("gpt-4.5-turbo", "gpt-4.1"),
    ("claude", "claude-sonnet-4-6"),
    ("claude-4-opus", "claude-opus-4-6"),
    ("claude-4-sonnet", "claude-sonnet-4-6"),
    ("claude-4-haiku", "claude-haiku-4-5"),
    ("claude-4.5-opus", "claude-opus-4-7"),
    ("claude-4.5-sonnet", "claude-sonnet-4-6"),
    ("claude-4.5-haiku", "claude-haiku-4-5"),
    ("claude-5", "claude-opus-4-7"),
    ("opus", "claude-opus-4-7"),
    ("sonnet", "claude-sonnet-4-6"),
    ("haiku", "claude-haiku-4-5"),
    ("gemini", "gemini-3-flash"),
    ("gemini-pro", "gemini-3.1-pro"),
    ("gemini-2.0-pro", "gemini-2.5-pro"),
    ("gemini-2.0-flash", "gemini-2.5-flash"),
    ("llama", "llama-4-maverick"),
    ("llama-4", "llama-4-maverick"),
    ("llama-4-large", "llama-4-maverick"),
    ("scout", "llama-4-scout"),
    ("maverick", "llama-4-maverick"),
    ("mistral", "mistral-large-3"),
    ("mistral-large-2", "mistral-large-3"),
    ("mistral-medium-2", "mistral-medium-3"),
    ("magistral", "magistral-medium"),
    ("grok", "grok-4"),
    ("deepseek", "deepseek-v3.2"),
    ("qwen", "qwen3-max"),
    ("cohere", "command-a"),
    ("command", "command-a"),
    ("reasoning", "o3"),
]

DEFAULT_MODEL = "gpt-5.4"
DEFAULT_OUTPUT_TOKENS = 1000
DEFAULT_TOKENIZER = "cl100k_base"

# Example token counts priced by the profile view.
EXAMPLE_TOKEN_COUNTS = [(1000, "1K tokens"), (10000, "10K tokens"),
                        (50000, "50K tokens"), (100000, "100K tokens")]

# Paths ignored by the change watcher (regular expressions, not ignore rules).
WATCH_IGNORE_REGEXES = [r"(^|[/\\])\.", r"node_modules", r"\.git", r"dist", r"build"]
DEFAULT_DEBOUNCE_MS = 1000
WRITE_STABILITY_MS = 500

# Rule files read from the root of each corpus.
RULE_FILES = [".gitignore", ".ctxignore"]

# Rendering strings.
PLAIN_SEPARATOR = "=" * 60
XML_DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'
# -------------------------------------------------------------- END FIXED VALUES

# Advice texts on splitting, and the strategies it names.
SPLIT_UNKNOWN = "Use --max-tokens flag to specify limit"
SPLIT_FITS = "Content fits within context limit"
SPLIT_STRATEGIES = ["by_tokens", "by_directory", "by_type"]
