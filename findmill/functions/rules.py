"""Fixed values of the audit rules: scan modes, model profiles, vocabularies and defaults."""

from __future__ import annotations

from typing import NamedTuple

class Mode(NamedTuple):
    suffixes: tuple[str, ...]
    severities: tuple[str, ...]
    per_response: int


class Profile(NamedTuple):
    chunk_size: int
    context: int
    whole_file: bool
    model: str
    max_calls: int


class Model(NamedTuple):
    parallel: int
    timeout: int
    latency: str
    eco: bool


#: Fixed values.
SEVERITIES = ("Critical", "High", "Medium", "Low")
CHUNK_OVERLAP = 500
MIN_CONFIDENCE = 20
LOG_LINES = 501
HISTORY_ROWS = 50
PRUNED_DIRS = ("node_modules", ".git", "venv", "dist", "build", "__pycache__", ".venv")
MODES = {
    "rapid": Mode((".py", ".js", ".ts", ".php", ".java", ".go"), ("Critical", "High"), 3),
    "deep": Mode(
        (".py", ".js", ".jsx", ".ts", ".tsx", ".php", ".java", ".c", ".cpp", ".rs", ".go", ".sql", ".yaml", ".xml"),
        ("Critical", "High", "Medium"), 6,
    ),
    "devsecops": Mode(
        (".yaml", ".yml", ".json", ".env", ".toml", "Dockerfile", "docker-compose.yml", ".py", ".js", ".ts", ".go", ".java", ".php"),
        SEVERITIES, 12,
    ),
}
PROFILES = {
    "eco": Profile(4000, 8192, False, "deepseek-coder:6.7b", 1),
    "balanced": Profile(12000, 16384, False, "qwen2.5-coder:14b", 2),
    "elite": Profile(24000, 32768, False, "qwen2.5-coder:32b", 4),
    "titan": Profile(100000, 131072, True, "qwen2.5-coder:32b", 6),
}
MODELS = {
    "deepseek-coder:6.7b": Model(1, 240, "high", True),
    "qwen2.5-coder:14b": Model(1, 180, "medium", False),
    "qwen2.5-coder:32b": Model(2, 150, "low", False),
}
DEFAULT_MODE, DEFAULT_PROFILE, DEFAULT_MODEL = "deep", "balanced", Model(1, 180, "medium", False)
FALLBACK_MODEL = "deepseek-coder:6.7b"
SOFT_TERMS = (
    "peut-être", "potentiellement", "il semble", "probablement", "peut être", "possiblement", "éventuellement",
    "peut-etre", "maybe", "potentially", "seems", "probably", "possibly",
)
IMPLAUSIBLE = {
    "css": ("XSS", "SQL Injection", "SQLi", "RCE", "Command Injection", "Buffer Overflow"),
    "md": ("SQL Injection", "SQLi", "Buffer Overflow", "XSS"),
    "json": ("SQL Injection", "SQLi", "XSS", "RCE", "Command Injection"),
    "yaml": ("XSS", "SQLi"),
    "yml": ("XSS", "SQLi"),
    "txt": ("XSS", "SQLi", "RCE", "Buffer Overflow"),
    "xml": ("SQLi",),
    "html": ("SQLi", "Buffer Overflow"),
    "svg": ("SQLi", "RCE"),
    "cpp": ("XSS",),
    "c": ("XSS",),
    "rs": ("XSS",),
}
DEFAULTS = {
    "title": "Vulnérabilité Inconnue", "description": "Pas de description fournie.", "fix": "Pas de correctif proposé.",
    "snippet": "Code non disponible", "type": "Unknown", "pattern": "Non spécifié", "exploit_example": "Non fourni",
    "business_impact": "Non évalué", "attack_vector": "Unknown",
}
#: Addresses of a model server: in a container, outside, and those that are tried after either.
CONTAINER_ENDPOINTS = ("http://host.docker.internal:11434/api/generate", "http://ollama:11434/api/generate", "http://172.17.0.1:11434/api/generate")
NATIVE_ENDPOINTS = ("http://127.0.0.1:11434/api/generate", "http://localhost:11434/api/generate")
OTHER_ENDPOINTS = ("http://localhost:11434/api/generate", "http://host.docker.internal:11434/api/generate")
DEFAULT_ENDPOINT, ENDPOINT_VARIABLE, PROBE_MODEL = "http://localhost:11434/api/generate", "OLLAMA_URL", "llama3"
NO_LINE, NO_CONTEXT = "Ligne inconnue.", "Impossible d'extraire le contexte : "
FIX_TIMES = {"Critical": "2-4h", "High": "1-2h", "Medium": "30min-1h", "Low": "15-30min"}


def mode_of(name: str | None) -> Mode:
    return MODES.get(name or "", MODES[DEFAULT_MODE])


def profile_of(name: str | None) -> Profile:
    return PROFILES.get(name or "", PROFILES[DEFAULT_PROFILE])


def model_of(name: str | None) -> Model:
    return MODELS.get(name or "", DEFAULT_MODEL)
