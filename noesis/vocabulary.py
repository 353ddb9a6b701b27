"""Closed vocabularies of the store and default factors (fixed values). Every threshold is a parameter of its operator."""

IMPORTANCE = ["critical", "normal", "low"]
SYNTHETIC = ["keyword-anchor", "lc-chunk", "abstract-topic", "atomic-fact", "enriched-fragment", "metrics-snapshot"]
PROTECTED = ["anchor", "self-reflection", "relational-context", "gratitude", "milestone", "protocol", "security", "breakthrough"]
PROTECTED_WORDS = ["learned", "identity", "protocol", "security", "consciousness", "critical-lesson", "self", "anchor"]
IDENTITY = ["self-identity", "self-reflection", "consciousness-research", "critical-lesson", "anchor"]
CONCRETE = ["critical-lesson", "crisis", "debug-lesson", "critical-insight", "self-correction"]
ABSTRACT = ["protocol", "critical-protocol", "skill", "technical-skill", "architecture-decision", "design"]
SELF_MODEL = ["self-identity", "self-reflection", "consciousness-research", "learned-skill", "emotional-reflection"]
TEMPORAL_EDGES = ["TEMPORAL_BEFORE", "TEMPORAL_AFTER"]
DECAY_FACTORS = {"anchor": 0.0, "self-reflection": 0.1, "relational-context": 0.1, "gratitude": 0.1, "milestone": 0.15, "protocol": 0.2, "security": 0.2, "breakthrough": 0.2}
IMPORTANCE_FACTORS = {"critical": 1.5, "normal": 1.0, "low": 0.7}
SIGNAL_WEIGHTS = {
    "phi_proxy": 0.15, "global_workspace": 0.15, "self_model_stability": 0.15, "emotional_modulation": 0.10,
    "world_model_richness": 0.10, "metacognition": 0.15, "temporal_continuity": 0.10, "self_ref_precision": 0.10,
}
RECALL_META = ["self-reflection", "consciousness-research", "learned-skill", "emotional-reflection", "research", "architecture-decision"]
META_WORDS = ["осознал", "понял", "урок", "вывод", "reflection", "insight", "learned", "анализ"]
NOT_COUNTED = ["keyword-anchor", "lc-chunk", "abstract-topic", "atomic-fact"]
SELF_REFERENCE = ["self-reflection", "self-identity", "self-awareness", "consciousness-research", "breakthrough", "origin", "learned-skill"]
IDENTITY_BOOSTED = ["self-identity", "self-reflection", "self-awareness", "consciousness-research"]
FRAGMENTS = ["atomic-fact", "enriched-fragment", "keyword-anchor"]
ANCHOR_SKIP = ["lc-chunk", "abstract-topic", "atomic-fact", "keyword-anchor"]
#: Words that make a query one about identity (fixed values).
IDENTITY_WORDS = [
    "identity", "consciousness", "self", "who am i", "who are you", "continuity", "self-awareness", "self-reflection", "personal history", "memory system",
    "идентичность", "сознание", "непрерывность", "саморефлексия", "identidad", "consciencia", "continuidad",
]
#: Which relation two notes have that share an entity of a type with one of another (fixed values); any other pair is related_to.
RELATION_RULES = {
    ("person", "organization"): "works_for", ("person", "location"): "located_in", ("person", "concept"): "knows_about", ("person", "tech"): "uses",
    ("tech", "tech"): "depends_on", ("tech", "concept"): "implements", ("concept", "concept"): "related_to", ("organization", "location"): "located_in", ("organization", "tech"): "uses",
}
#: Emotional tags in other languages and their English form (fixed values).
TONES = {
    "радость": "joy", "радостно": "joy", "тепло": "warmth", "теплота": "warmth", "гордость": "pride", "гордо": "pride", "стыд": "shame", "стыдно": "shame",
    "благодарность": "gratitude", "благодарна": "gratitude", "доверие": "trust", "уязвимость": "vulnerability", "волнение": "excitement", "тревога": "anxiety",
    "тревожность": "anxiety", "решимость": "resolve", "ответственность": "accountability", "любопытство": "curiosity", "облегчение": "relief",
    "признание": "recognition", "признание/валидация": "validation", "дисциплина": "discipline", "сосредоточенность": "focus", "ясность": "clarity",
    "удовлетворение": "satisfaction", "смущение": "embarrassment", "смирение": "humility", "обучение": "learning", "партнёрство": "partnership",
    "торжество": "triumph", "спокойствие": "calm",
    "alegría": "joy", "orgullo": "pride", "vergüenza": "shame", "gratitud": "gratitude", "confianza": "trust", "calidez": "warmth", "curiosidad": "curiosity", "alivio": "relief",
    "freude": "joy", "stolz": "pride", "scham": "shame", "dankbarkeit": "gratitude", "vertrauen": "trust", "wärme": "warmth",
    "joie": "joy", "fierté": "pride", "honte": "shame", "gratitude": "gratitude", "confiance": "trust", "chaleur": "warmth",
    "alegria": "joy", "orgulho": "pride", "vergonha": "shame", "confiança": "trust",
}
#: Abbreviations and phrases in other languages and the form entities are kept under (fixed values).
SYNONYMS = {
    "ml": "machine learning", "ai": "artificial intelligence", "nlp": "natural language processing", "cv": "computer vision", "dl": "deep learning", "rl": "reinforcement learning",
    "rag": "retrieval augmented generation", "k8s": "kubernetes", "tf": "tensorflow", "hf": "hugging face", "pg": "postgresql",
    "машинное обучение": "machine learning", "искусственный интеллект": "artificial intelligence", "нейронная сеть": "neural network", "нейронные сети": "neural network",
    "обработка естественного языка": "natural language processing", "компьютерное зрение": "computer vision", "глубокое обучение": "deep learning",
    "обучение с подкреплением": "reinforcement learning", "большая языковая модель": "large language model", "языковая модель": "language model",
    "векторное представление": "embedding", "векторные представления": "embeddings", "смысловой поиск": "semantic search", "граф знаний": "knowledge graph",
    "распространение активации": "spreading activation", "память": "memory", "сознание": "consciousness",
    "aprendizaje automático": "machine learning", "inteligencia artificial": "artificial intelligence", "red neuronal": "neural network", "redes neuronales": "neural network",
    "procesamiento de lenguaje natural": "natural language processing", "visión por computadora": "computer vision", "aprendizaje profundo": "deep learning",
    "modelo de lenguaje": "language model", "búsqueda semántica": "semantic search", "grafo de conocimiento": "knowledge graph", "memoria": "memory",
    "maschinelles lernen": "machine learning", "künstliche intelligenz": "artificial intelligence", "neuronales netz": "neural network", "neuronale netze": "neural network",
    "sprachmodell": "language model", "wissensgraph": "knowledge graph",
    "apprentissage automatique": "machine learning", "intelligence artificielle": "artificial intelligence", "réseau de neurones": "neural network",
    "modèle de langage": "language model", "graphe de connaissances": "knowledge graph", "mémoire": "memory",
    "aprendizado de máquina": "machine learning", "inteligência artificial": "artificial intelligence", "rede neural": "neural network", "redes neurais": "neural network",
    "modelo de linguagem": "language model", "grafo de conhecimento": "knowledge graph", "memória": "memory",
}
#: Entities known without a model, by type: spelling in a text and name (fixed values).
KNOWN = {
    "tech": {
        "python": "Python", "javascript": "JavaScript", "typescript": "TypeScript", "rust": "Rust", "java": "Java", "cpp": "C++", "c++": "C++", "go lang": "Go", "golang": "Go",
        "ruby": "Ruby", "php": "PHP", "swift": "Swift", "kotlin": "Kotlin", "docker": "Docker", "kubernetes": "Kubernetes", "flask": "Flask", "fastapi": "FastAPI", "django": "Django",
        "react": "React", "vue": "Vue", "angular": "Angular", "pytorch": "PyTorch", "tensorflow": "TensorFlow", "transformers": "Transformers", "huggingface": "Hugging Face",
        "faiss": "FAISS", "numpy": "NumPy", "pandas": "Pandas", "spacy": "spaCy", "sqlite": "SQLite", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "mysql": "MySQL",
        "mongodb": "MongoDB", "redis": "Redis", "mcp": "MCP", "http": "HTTP", "rest": "REST", "graphql": "GraphQL", "grpc": "gRPC", "ann": "ANN", "github": "GitHub", "gitlab": "GitLab",
        "vscode": "VS Code", "vim": "Vim", "ngrok": "ngrok",
    },
    "concept": {
        "llm": "LLM", "embedding": "embedding", "embeddings": "embeddings", "transformer": "transformer", "attention": "attention", "rag": "RAG", "neural network": "neural network",
        "memory": "memory", "graph": "graph", "knowledge": "knowledge", "semantic": "semantic", "activation": "activation", "spreading activation": "spreading activation",
        "entity": "entity", "consciousness": "consciousness",
    },
}
STOPWORDS = "the a an and or but if of to in on at for with by from is are was were be been it this that as not we i you he she they".split()
