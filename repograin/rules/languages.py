# Extension -> language, ignored directories, scan globs, caps.

LANGUAGE_BY_EXTENSION = {
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "py": "python",
    "java": "java",
    "rs": "rust",
    "go": "go",
    "cpp": "cpp",
    "cxx": "cpp",
    "cc": "cpp",
    "c": "c",
    "h": "header",
    "hpp": "header",
    "hxx": "header",
    "md": "markdown",
    "markdown": "markdown",
    "yaml": "yaml",
    "yml": "yaml",
}

IGNORED_DIRECTORIES = [
    "venv", "env", ".env", "virtualenv", ".venv",
    "node_modules", ".pnpm-store",
    ".git", ".svn", ".hg",
    "target", "build", "dist", "out",
    "__pycache__", ".pytest_cache",
    ".idea", ".vscode", ".vs",
    "vendor",
    ".specstory",
]

MARKER_INCLUDE = ["*.rs", "*.py", "*.js", "*.ts", "*.java", "*.cpp", "*.c", "*.h", "*.go"]
MARKER_EXCLUDE = ["target/**", "node_modules/**", "*.min.js", "*.bundle.js", ".git/**"]

REALITY_INCLUDE = [
    "**/*.java", "**/*.ts", "**/*.js", "**/*.py", "**/*.rs", "**/*.go",
    "**/package.json", "**/Cargo.toml", "**/pom.xml", "**/build.gradle", "**/requirements.txt",
    "**/Dockerfile", "**/*.yml", "**/*.yaml",
]
REALITY_EXCLUDE = [
    "**/node_modules/**", "**/target/**", "**/build/**", "**/.git/**", "**/dist/**", "**/coverage/**",
]

DOC_PATTERNS = ["README.md", "README.rst", "docs/**/*.md", "docs/**/*.rst", "CONTRIBUTING.md", "API.md", "CHANGELOG.md"]
CLAIM_PATTERNS = [
    "README.md", "README.rst", "docs/**/*.md", "documentation/**/*.md", "wiki/**/*.md",
    "API.md", "FEATURES.md", "CHANGELOG.md", "package.json", "Cargo.toml",
]

# Sizes and depth above which the size report flags a file; no scan leaves a file out for them.
MARKER_MAX_MB = 10
MARKER_MAX_DEPTH = 10
REALITY_MAX_KB = 1000
DOCUMENT_MAX_KB = 500
