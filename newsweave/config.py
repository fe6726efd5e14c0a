"""Domain constants and settings; every value is a parameter of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on them as they stand.
TOPICS = ("models", "papers", "agents", "products", "tools", "open_source", "regulation")
SOURCES = ("hackernews", "arxiv", "reddit", "rss", "github", "huggingface", "webscraper")
TOPIC_KEYWORDS: dict[str, tuple[str, ...]] = {
    "models": (
        "GPT", "LLM", "model", "foundation model", "benchmark", "MMLU", "training", "fine-tuning", "weights", "parameters",
        "transformer", "diffusion", "multimodal", "vision language", "Llama", "Mistral", "Gemini", "Claude", "Qwen",
        "DeepSeek", "SOTA", "perplexity", "architecture", "attention", "context window", "token",
    ),
    "tools": (
        "framework", "library", "SDK", "API", "platform", "tool", "LangChain", "LlamaIndex", "HuggingFace", "vLLM", "Ollama",
        "deployment", "inference", "serving", "MLOps", "vector database", "embedding", "RAG pipeline", "prompt engineering",
        "eval",
    ),
    "papers": (
        "paper", "research", "arxiv", "study", "findings", "novel", "approach", "method", "algorithm", "SOTA",
        "state-of-the-art", "NeurIPS", "ICML", "ICLR", "ACL", "EMNLP", "CVPR", "experiment", "ablation", "preprint",
    ),
    "products": (
        "launch", "release", "product", "feature", "update", "app", "ChatGPT", "Claude", "Gemini", "Copilot", "assistant",
        "pricing", "API", "beta", "GA", "general availability", "subscription", "enterprise", "consumer",
    ),
    "open_source": (
        "open source", "open-source", "OSS", "GitHub", "weights", "MIT", "Apache", "license", "community", "Llama", "Mistral",
        "Qwen", "DeepSeek", "Falcon", "self-hosted", "local", "on-premise",
    ),
    "agents": (
        "agent", "agentic", "MCP", "tool use", "function calling", "autonomous", "workflow", "orchestration", "multi-agent",
        "reasoning", "planning", "code generation", "computer use", "browser use", "automation", "chain of thought",
    ),
    "regulation": (
        "regulation", "policy", "law", "ban", "safety", "alignment", "ethics", "bias", "EU", "AI Act", "executive order",
        "governance", "responsible", "risk", "compliance", "copyright", "deepfake", "misinformation",
    ),
}
TOPIC_WEIGHTS = {
    "models": 1.0, "products": 1.0, "regulation": 1.0, "agents": 0.95, "tools": 0.85, "open_source": 0.85, "papers": 0.70,
}
SOURCE_CREDIBILITY = {
    "arxiv": 0.3, "rss": 0.25, "hackernews": 0.2, "github": 0.2, "github_search": 0.2, "huggingface": 0.2, "reddit": 0.1,
}
VELOCITY_THRESHOLDS = {
    "github": 1000.0, "github_search": 1000.0, "hackernews": 0.15, "reddit": 0.15, "huggingface": 1_000_000.0,
    "huggingface_paper": 50.0,
}
TRUSTED_DOMAINS = (
    "openai.com", "anthropic.com", "deepmind.google", "ai.meta.com", "huggingface.co", "arxiv.org", "github.com",
    "techcrunch.com", "theverge.com", "wired.com", "arstechnica.com", "reuters.com",
)
AUTHORITATIVE_DOMAINS = (
    "anthropic.com", "openai.com", "deepmind.google", "ai.meta.com", "mistral.ai", "blog.google", "huggingface.co",
    "qwenlm.github.io", "deepseek.com",
)
SUSPICIOUS_PATTERNS = (
    r"(?i)\b(shocking|unbelievable|you won'?t believe)\b", r"(?i)\b(miracle|secret|conspiracy)\b",
    r"(?i)\b(act now|limited time|don'?t miss)\b", r"[!]{2,}", r"[A-Z]{5,}",
)
PROFESSIONAL_PATTERNS = (
    r"(?i)\b(research|study|findings|published)\b", r"(?i)\b(according to|researchers|scientists|engineers)\b",
    r"(?i)\b(paper|journal|conference|proceedings)\b", r"(?i)\b(analysis|methodology|experiment|evaluation)\b",
    r"(?i)\b(announcement|release|update|version)\b",
)
QUANTISED_SUFFIX = r"(?i)-(GGUF|GPTQ|AWQ|ONNX|EXL2|MLX|FP8|FP16|NVFP4|abliterated|censored)$"
PARAMETER_SIZE = r"(?i)-\d+\.?\d*B(-A\d+\.?\d*B)?"
REPO_KEYWORDS = (
    r"(?i)\b(ai|llm|gpt|transformer|neural|machine.?learning|deep.?learning|nlp|diffusion|embedding|rag|agent|langchain|"
    r"pytorch|tensorflow|hugging.?face|openai|anthropic|gemini|claude|llama|mistral|fine.?tun|rlhf|bert|attention|inference|"
    r"model|ml|gen.?ai|computer.?vision|object.?detect|stable.?diffusion|lora|vector.?database|chatbot|copilot|prompt|"
    r"benchmark)\b"
)
NON_CONTENT_SEGMENTS = (
    "about", "careers", "contact", "cookie", "faq", "help", "legal", "login", "logout", "pricing", "privacy", "register",
    "signup", "sign-up", "signin", "sign-in", "subscribe", "terms", "tos",
)
SCORE_BUCKETS = (("0-10", 0, 10), ("11-50", 11, 50), ("51-100", 51, 100), ("101-250", 101, 250), ("251-500", 251, 500), ("501+", 501, None))
#: Words that item tokens leave out (English, Spanish, and frequent words of the field).
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below", "between", "out", "off", "over", "under",
    "again", "further", "then", "once", "and", "but", "or", "nor", "not", "so", "yet", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "only", "own", "same", "than", "too", "very", "just", "about", "up", "its",
    "it", "this", "that", "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her",
    "they", "them", "their", "what", "which", "who", "whom", "how", "when", "where", "why", "all", "if", "there", "here",
    "el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "en", "con", "por", "para", "al", "es", "son",
    "fue", "ser", "como", "mas", "pero", "su", "sus", "se", "le", "lo", "que", "y", "o", "e", "ni", "si", "ya", "ha",
    "han", "hay",
    "ai", "model", "new", "data", "using", "based", "learning",
)


@dataclass(frozen=True)
class Settings:
    min_relevance: float = 0.75
    velocity_weights: tuple[float, float, float, float] = (0.35, 0.30, 0.20, 0.15)  # velocity, relevance, recency, topic
    plain_weights: tuple[float, float, float] = (0.45, 0.30, 0.25)  # relevance, recency, topic
    recency_hours: float = 48.0
    mmr_lambda: float = 0.7
    most_ranked: int = 2_000  # ranks of one feed; its pool goes into one task
    candidate_multiplier: int = 5
    feed_hours: float = 48.0
    feed_min_items: int = 5
    feed_windows: tuple[int, ...] = (48, 72, 168)
    seen_days: int = 7
    seen_titles: int = 2000
    title_similarity: float = 0.80
    title_length_ratio: float = 0.6
    jaccard: float = 0.65
    event_group_limit: int = 100
    min_credibility: float = 0.3
    min_social_score: int = 5
    keywords: dict = field(default_factory=lambda: TOPIC_KEYWORDS)
    topics: tuple[str, ...] = TOPICS
    trusted: tuple[str, ...] = TRUSTED_DOMAINS
    stopwords: tuple[str, ...] = STOPWORDS


DEFAULT = Settings()
