"""Stop words, intent patterns and keywords used by the text operators."""

# Word pattern and stop words.
TOKEN = r"[a-zA-Z0-9_]+"
CLOUD_STOP_WORDS = ["the", "a", "an", "and", "is", "in", "to", "of", "for", "with", "on", "at", "this", "that", "it", "as", "by"]
COMMON_STOP_WORDS = CLOUD_STOP_WORDS + ["are", "was", "were"]

# Intent patterns of questions, in order of preference.
INTENTS = {
    "question": [
        r"(what|what's|calculate|compute|find|tell me|show me).*(average|mean|median|sum|count|min|max)",
        r"how many.+\?",
        r"(what is|what's|what are|what percentage)",
        r"(why|when|where|who|which|how much|how long|how often)",
    ],
    "visualization": [
        r"(visualize|plot|draw|show|display|create|make|generate).*(chart|graph|plot)",
        r"(bar chart|line chart|scatter plot|pie chart|histogram|heatmap|treemap)",
        r"(visualize|visualisation|visualization)",
        r"(show|display).*(data|trend|pattern|distribution)",
        r"(graph|chart|plot).*(data|trend|pattern|distribution)",
    ],
    "analysis": [
        r"(analyze|analyse|analysis|examine|study|investigate)",
        r"(compare|correlation|relationship|association)",
        r"(trend|pattern|fluctuation|variation|change over time)",
        r"(statistical|statistics|stats|descriptive analysis)",
    ],
    "insight": [
        r"(insight|key finding|important|significant|highlight)",
        r"(interesting|notable|remarkable|noteworthy)",
        r"(summarize|summary|overview|takeaway|key point)",
    ],
    "prediction": [
        r"(predict|forecast|projection|estimation)",
        r"(will|future|expected|anticipated|projected)",
        r"(model|regression|classification|clustering|machine learning)",
    ],
}
CHART_KEYWORDS = {
    "bar": ["bar", "column"],
    "line": ["line", "trend", "time series"],
    "scatter": ["scatter", "correlation", "relationship"],
    "pie": ["pie", "proportion", "distribution"],
    "histogram": ["histogram", "distribution", "frequency"],
    "heatmap": ["heat", "heatmap", "correlation", "matrix"],
}

# Patterns for (question, SQL) pairs.
SQL_INTENTS = {
    "question": [r"select\s+count\(", "how many", "count", r"select\s+(avg|average|mean)\(", "average", "mean", "median",
                 r"select\s+sum\(", "sum", "total", r"select\s+max\(", "maximum", "highest", "largest",
                 r"select\s+min\(", "minimum", "lowest", "smallest", "query", "give me", "show me", "list", "find"],
    "visualization": ["draw", "plot", "chart", "graph", "visualize", "display", "bar chart", "line chart", "pie chart",
                      "histogram", "scatter plot", "visualization", "visualisation"],
    "analysis": ["analyze", "analyse", "analysis", "examine", "compare", "correlation", "relationship", "trend", "pattern",
                 "group by", "order by"],
    "insight": ["insight", "key finding", "important", "highlight", "significant", "interesting", "notable", "summarize", "overview"],
    "prediction": ["predict", "forecast", "future", "estimate", "will", "expected", "projection"],
}
SQL_CHARTS = {
    "bar": ["bar chart", "bar graph", "column chart"],
    "line": ["line chart", "line graph", "trend", "over time"],
    "pie": ["pie chart", "pie graph", "proportion", "distribution", "percentage"],
    "scatter": ["scatter plot", "scatter graph", "correlation", "relationship"],
    "histogram": ["histogram", "distribution"],
}
SQL_KEYWORDS = ["from", "as", "where", "and", "or", "not", "in", "exists", "asc", "desc"]
SQL_COLUMNS = [r"(?:sum|avg|max|min|count)\s*\(\s*([a-zA-Z0-9_.]+)\s*\)", r"(?:select|where|group by|order by)\s+([a-zA-Z0-9_.]+)"]

# Chart words in labelled questions.
LABEL_CHARTS = [("bar", ["transfer", "transactions"]), ("line", ["spending", "history"]), ("pie", ["income", "distribution"]),
                ("scatter", ["compare", "correlation"]), ("calendar", ["calendar"])]

# Commands in replies.
ACTION = r"Action: \w+\s*\nAction Input: .+?(?=\nObservation:|$)"
CHART_ACTIONS = ["generate_chart", "generate_visualization", "visualize"]
INSIGHT_ACTIONS = ["generate_insights", "analyze_data"]
CHART_REQUESTS = [
    r"(?i)(?:visualize|plot|draw|chart|graph|show|display)\s*\(\s*([^)]+)\)",
    r"(?i)(?:visualize|plot|draw|chart|graph|show|display)\s+([a-zA-Z0-9_,\s]+)",
    r"(?i)(?:create|make|generate)\s+(?:a|an)?\s*(?:chart|graph|plot|visualization)\s+(?:of|for)\s+([a-zA-Z0-9_,\s]+)",
    r"(?i)(?:show|display)\s+([a-zA-Z0-9_,\s]+)\s+(?:as|in|with|using)\s+(?:a|an)?\s*(?:chart|graph|plot|visualization)",
]
PARAMETER_BREAK = r"[,\s]+and\s+|\s*,\s*|\s+vs\.?\s+|\s+against\s+|\s+by\s+"
CHART_CALL = r"(?i)(?:bar|line|scatter|pie|histogram)\s*\(\s*[^)]+\)"
INSIGHT_CALL = r"(?i)(?:insight|analyze)\s*\(\s*([^)]*)\)"

# Insight types named in written blocks.
BLOCK_TYPES = ["DISTRIBUTION", "CORRELATION", "TREND", "OUTLIER", "PATTERN", "BINARY", "LIKERT", "GENDER", "RANGE", "TEXT"]

# Calling codes.
CALLING_CODES = {
    "1": "USA/Canada", "44": "UK", "49": "Germany", "33": "France", "81": "Japan", "86": "China", "91": "India", "61": "Australia",
    "55": "Brazil", "7": "Russia", "82": "South Korea", "39": "Italy", "34": "Spain", "52": "Mexico", "971": "UAE", "65": "Singapore",
    "31": "Netherlands", "48": "Poland", "966": "Saudi Arabia", "46": "Sweden", "41": "Switzerland", "84": "Vietnam",
    "63": "Philippines", "62": "Indonesia", "60": "Malaysia", "66": "Thailand", "234": "Nigeria", "27": "South Africa",
    "20": "Egypt", "972": "Israel",
}
