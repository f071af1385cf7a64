"""Word lists and tables that the rules share. All are fixed values."""

IGNORED_DIRECTORIES = [
    "node_modules", ".git", ".next", ".nuxt", ".svelte-kit", "dist", "build", "out",
    "coverage", ".turbo", ".vercel", ".idea", ".vscode", ".cache", "tmp", "temp",
]
GENERATED_PATH_PARTS = [
    "/dist/", "/build/", "/out/", "/coverage/", "/.next/", "/.nuxt/", "/.svelte-kit/", "/.turbo/",
    "/generated/", "/.cache/", "/reports/selector-benchmark/",
]
GENERATED_FILE_NAMES = ["next-env.d.ts", "vite-env.d.ts", "auto-imports.d.ts", "components.d.ts"]
TEXT_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".css", ".scss", ".sass", ".less", ".html", ".json",
    ".md", ".mdx", ".txt", ".yml", ".yaml", ".toml", ".env", ".example", ".sql", ".prisma", ".graphql", ".gql", ".xml", ".svg",
]
SOURCE_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".py", ".cs", ".java", ".go",
    ".rs", ".php", ".rb", ".swift", ".kt", ".kts",
]
STYLE_EXTENSIONS = [".css", ".scss", ".sass", ".less"]
ASSET_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg", ".ico", ".bmp", ".avif", ".mp4", ".webm", ".mov", ".mp3",
    ".wav", ".ogg", ".woff", ".woff2", ".ttf", ".otf",
]
DATA_EXTENSIONS = [".db", ".sqlite", ".sqlite3", ".csv", ".xlsx", ".xls", ".db-wal", ".db-shm"]
CONFIG_FILE_NAMES = [
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "tsconfig.json",
    "tsconfig.app.json", "tsconfig.node.json", "jsconfig.json", "vite.config.ts", "vite.config.js", "vite.config.mjs",
    "vite.config.cjs", "next.config.ts", "next.config.js", "next.config.mjs", "next.config.cjs", "tailwind.config.ts",
    "tailwind.config.js", "tailwind.config.mjs", "tailwind.config.cjs", "postcss.config.js", "postcss.config.mjs",
    "postcss.config.cjs", "eslint.config.js", "eslint.config.mjs", "eslint.config.cjs", ".eslintrc", ".eslintrc.json",
    ".eslintrc.js", ".prettierrc", ".prettierrc.json", "dockerfile", "docker-compose.yml", "docker-compose.yaml",
]
DOC_FILE_NAMES = ["readme.md", "agents.md", "claude.md", "contributing.md", "license.md", "changelog.md"]
TEST_MARKS = [".test.", ".spec.", "/tests/", "/__tests__/", ".smoke.", ".replay."]
PAGE_FILES = ["page.tsx", "page.jsx", "page.ts", "page.js"]
LAYOUT_FILES = ["layout.tsx", "layout.jsx", "layout.ts", "layout.js", "template.tsx", "template.jsx"]
ENTRY_FILES = ["app.tsx", "app.jsx", "main.tsx", "main.jsx", "index.tsx", "index.jsx"]
ROUTE_FILES = ["route.ts", "route.js", "route.mjs", "route.cjs"]
LOCK_FILES = ["pnpm-lock.yaml", "yarn.lock", "package-lock.json", "bun.lockb", "bun.lock", "npm-shrinkwrap.json"]
ENV_EXAMPLES = [
    ".env.example", ".env.sample", ".env.template", ".env.local.example", ".env.development.example", ".env.production.example",
]
DOC_NAMES_EXACT = [
    "README.md", "readme.md", "README.MD", "AGENTS.md", "AGENTS.generated.md", "agents.md", "CLAUDE.md", "CONTRIBUTING.md", "CHANGELOG.md",
]
README_NAMES = ["README.md", "readme.md", "README.MD"]
AGENT_NAMES = ["AGENTS.md", "AGENTS.generated.md", "agents.md", "CLAUDE.md", ".cursorrules"]
HINT_STOP_WORDS = [
    "the", "and", "for", "from", "this", "that", "with", "without", "const", "let", "var", "function", "return", "export",
    "default", "import", "type", "interface", "class", "extends", "props", "children", "string", "number", "boolean",
    "object", "array", "null", "undefined", "true", "false", "async", "await", "new", "set", "get", "use", "src", "app",
    "page", "component", "components", "style", "styles", "index", "main", "div", "span", "className", "это", "как", "что",
    "для", "или", "если", "надо", "нужно", "чтобы", "когда", "где", "при", "под", "над", "без", "его", "она", "они", "оно",
    "мне", "тебе", "тут", "все", "всё",
]
TASK_STOP_WORDS = [
    "the", "and", "for", "with", "from", "this", "that", "into", "add", "edit", "update", "change", "improve", "make",
    "project", "file", "files", "code", "screen", "app", "application", "для", "или", "это", "как", "чтобы", "надо",
    "нужно", "добавь", "измени", "обнови", "улучши", "сделай", "файл", "файлы", "код", "проект",
]
IDENTIFIER_STOP_WORDS = [
    "add", "change", "create", "edit", "fix", "improve", "make", "replace", "update", "with", "from", "into", "code", "file",
    "project", "task", "добавь", "измени", "замени", "исправь", "улучши", "код", "файл", "проект", "нужно", "через", "после",
    "который", "показывает", "отображение",
]
#: Readiness checks: key, label, points.
READINESS_CHECKS = [
    ("readme", "README", 12), ("agents", "AI agent instructions", 15), ("build-script", "Build command", 12),
    ("dev-script", "Dev command", 10), ("test-script", "Test command", 10), ("env-example", "Environment example", 10),
    ("typescript-config", "TypeScript config", 8), ("tests", "Tests structure", 10), ("docs", "Documentation", 9), ("ci", "CI workflow", 4),
]
#: Scores of benchmark severities when a case names no weight.
SEVERITY_WEIGHT = {"critical": 8, "high": 5, "medium": 3, "low": 1}

#: First words of the names of utilities, and of services of a server. Fixed values.
UTILITY_STEMS = [
    "calculation", "calculations", "formatter", "formatters", "validator", "validators", "parser", "parsers", "classify", "scoring", "risk", "appearance",
]
SERVICE_STEMS = ["auth", "session", "queue", "worker", "processor", "provider", "manager", "ai"]
#: Names of configurations by their first word, everywhere and within a server. Fixed values.
CONFIG_STEMS = ["robots", "sitemap", "manifest", "middleware"]
SERVER_CONFIG_STEMS = ["config", "settings"]
