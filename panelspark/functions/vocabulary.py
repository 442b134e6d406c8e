"""The word lists of key term extraction. Each function takes others in their place."""

STOPWORDS = """
the is are was were this that these those and or for with from into onto of to in on by an a as at it its be we our their
they them such using based approach method model system data provides provide providing provided demonstrate demonstrates
demonstrated demonstrating used use uses available recent recently currently highly however towards toward shown show shows
showed result results findings paper study studies present presented introduce introduces introducing
""".split()
GENERIC = "method approach model system data analysis study work paper learn learning analyze opinion task result".split()
SYNONYMS = {
    "nlp": "natural language processing",
    "transformers": "transformer",
    "learning": "learn",
    "models": "model",
    "networks": "network",
    "analysis": "analyze",
    "sentiment": "opinion",
}
CONCEPTS = {
    "nlp": ["natural language processing", "text classification"],
    "prompt": ["prompt learning", "few-shot learning", "prompt engineering"],
    "statistics": ["statistical extraction", "information extraction"],
    "graph": ["knowledge graph", "graph modeling"],
    "transformer": ["transformer models", "attention mechanism", "attention model", "transformer decoding"],
    "classification": ["text classification", "document classification"],
    "tabular": ["structured data querying", "semantic table understanding"],
    "chatbot": ["conversational interface", "dialog systems"],
    "conversation": ["conversational interface", "dialog systems"],
    "data": ["data analysis", "data exploration"],
    "template": ["prompt templates", "prompt design"],
    "verbalizer": ["prompt verbalizers", "label mapping in prompts"],
    "resume": ["information extraction", "document parsing"],
    "program synthesis": ["code generation", "program generation"],
    "code generation": ["program synthesis"],
    "decoding": ["generation", "inference", "transformer decoding"],
    "optimization": ["efficiency", "performance"],
}
LEXICAL_STOP = """
this that with from using based their these those into over under between among paper study approach method methods result results
""".split()
ACRONYMS = {
    "ai": ["artificial", "intelligence"],
    "bert": ["language", "model", "transformer"],
    "cnn": ["convolutional", "neural", "network"],
    "dl": ["deep", "learning"],
    "gnn": ["graph", "neural", "network"],
    "kg": ["knowledge", "graph"],
    "kgs": ["knowledge", "graph"],
    "llm": ["large", "language", "model"],
    "llms": ["large", "language", "model"],
    "ml": ["machine", "learning"],
    "nlp": ["natural", "language", "processing"],
    "rag": ["retrieval", "augmented", "generation"],
    "rl": ["reinforcement", "learning"],
}
PAPER_METHODS = "model graph learning retrieval classification interface".split()
REVIEWER_METHODS = "model graph learning retrieval classification semantic".split()
