def docs(texts, lang="en"):
    return [(i, t, lang, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
