"""Settings and fixed word lists.

The lists and weights below are fixed values: results depend on them. Pass other lists to the operators to change them.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Words that search scoring ignores.
STOPWORDS = """
the a an is are was were be been being have has had do does did will would could should may might can shall to
of in for on with at by from as into through during before after above below between and but or not no nor so
yet both each few more most other some such than too very just about also it its this that these those what
which who whom how when where why all any
""".split()

#: Words that the relevance gate ignores.
GATE_STOPWORDS = """
the and for are was were been with that this from have has will what how why when where which who about into
using used use new recent paper survey tutorial benchmark approach method based model data
""".split()

#: Words that do not anchor a research query.
GENERIC_WORDS = """
paper survey tutorial benchmark arxiv research algorithm approach method model results recent latest
implementation evaluation analysis review study overview introduction techniques applications performance
comparison advances future open problems challenges directions framework system design using based novel state
guide
""".split()

#: Domains left out of search results.
BLOCKED_RESULT_DOMAINS = """
chanel.com amazon.com ebay.com etsy.com walmart.com shopify.com twitter.com x.com facebook.com instagram.com
tiktok.com linkedin.com pinterest.com youtube.com youtu.be zhihu.com baidu.com weibo.com csdn.net ndtv.com
timesofindia.com hindustantimes.com indiatoday.in thehindu.com news18.com indianexpress.com jnj.com
investor.jnj.com careers.jnj.com pfizer.com merck.com bayer.com lichess.org en.lichess.org lichess.my chess.com
play.google.com apps.apple.com filmweb.pl imdb.com wwe.com espn.com espncricinfo.com transfermarkt.com
transfermarkt.co.in fcbayern.com forum.benchmark.pl benchmark.pl dxy.cn iciba.com polimetro.com cohotech.vn
mundowin.com pt.stackoverflow.com es.stackoverflow.com spanish.stackexchange.com data.gov.in data.gov
iras.gov.sg customs.gov.sg ncert.nic.in support.google.com support.microsoft.com support.apple.com w3schools.com
simplilearn.com numberanalytics.com stackoverflow.com stackexchange.com superuser.com serverfault.com
""".split()

#: Domains that are not scraped.
BLOCKED_PAGE_DOMAINS = """
twitter.com x.com facebook.com instagram.com tiktok.com linkedin.com pinterest.com youtube.com youtu.be
wikipedia.org en.wikipedia.org en.m.wikipedia.org wikibooks.org wikiversity.org wikiquote.org wiktionary.org
wikisource.org wikimedia.org simple.wikipedia.org quora.com answers.com ehow.com wikihow.com about.com
scribd.com slideshare.net reddit.com stackoverflow.com stackexchange.com superuser.com serverfault.com
askubuntu.com mathoverflow.net crossvalidated.com cppreference.com cplusplus.com docs.python.org
developer.mozilla.org docs.oracle.com learn.microsoft.com docs.microsoft.com support.google.com
support.microsoft.com support.apple.com help.github.com chanel.com amazon.com ebay.com etsy.com walmart.com
shopify.com zhihu.com baidu.com weibo.com csdn.net chiebukuro.yahoo.co.jp detail.chiebukuro.yahoo.co.jp
yahoo.co.jp oshiete.goo.ne.jp okwave.jp oshiete1.goo.ne.jp namu.wiki naver.com kin.naver.com hinative.com
lang-8.com tc-forum.co.jp chiphell.com ndtv.com timesofindia.com hindustantimes.com indiatoday.in thehindu.com
news18.com indianexpress.com tomsguide.com tomshardware.com forums.macrumors.com macrumors.com techradar.com
cnet.com zdnet.com theverge.com engadget.com wired.com gizmodo.com jnj.com investor.jnj.com careers.jnj.com
pfizer.com merck.com bayer.com lichess.org en.lichess.org lichess.my chess.com play.google.com apps.apple.com
filmweb.pl imdb.com wwe.com espn.com espncricinfo.com transfermarkt.com transfermarkt.co.in fcbayern.com nzc.nz
forum.benchmark.pl benchmark.pl dxy.cn iciba.com polimetro.com cohotech.vn mundowin.com vi.windowsnoticias.com
vi.101-help.com pchardwarepro.com tinhn.com smartcr.org pt.stackoverflow.com es.stackoverflow.com
spanish.stackexchange.com data.gov.in data.gov iras.gov.sg eservices.mas.gov.sg customs.gov.sg ncert.nic.in
w3schools.com simplilearn.com numberanalytics.com wolfram.com functions.wolfram.com reference.wolfram.com
mathematica.stackexchange.com howtogeek.com makeuseof.com digitaltrends.com answers.yahoo.com
""".split()

#: Domains that are scraped first.
PRIORITY_DOMAINS = """
arxiv.org medium.com towardsdatascience.com openreview.net aclanthology.org semanticscholar.org
scholar.google.com ieee.org acm.org springer.com nature.com sciencedirect.com pnas.org pubmed.ncbi.nlm.nih.gov
distill.pub paperswithcode.com huggingface.co blog.research.google ai.meta.com deepmind.google openai.com
anthropic.com proceedings.neurips.cc proceedings.mlr.press cv-foundation.org ecva.net
""".split()

#: Words in URLs that hint at research.
URL_HINTS = """
arxiv paper research journal conference ieee acm springer nature github huggingface openreview proceedings
preprint abstract pdf publication scholar vision detection segmentation neural deep learning model dataset
benchmark survey transformer convolution attention
""".split()

#: Keyword in place of a ``site:`` operator, for web search and for research plans (most specific first).
SITE_KEYWORDS = {
    "arxiv.org": "arxiv", "medium.com": "", "towardsdatascience.com": "", "neurips.cc": "neurips", "icml.cc": "icml",
    "aclanthology.org": "acl", "cvpr.thecvf.com": "cvpr", "ieeexplore.ieee.org": "ieee", "acm.org": "acm",
    "researchgate.net": "", "cv-foundation.org": "cvpr", "openreview.net": "", "semanticscholar.org": "",
    "springer.com": "", "nature.com": "", "sciencedirect.com": "",
}
PLAN_SITE_KEYWORDS = {
    "arxiv.org": "arxiv", "medium.com": "", "towardsdatascience.com": "", "neurips.cc": "neurips paper",
    "icml.cc": "icml paper", "aclanthology.org": "acl paper", "cvpr.thecvf.com": "cvpr paper",
    "ieeexplore.ieee.org": "ieee paper", "acm.org": "acm paper", "researchgate.net": "",
    "cv-foundation.org": "cvpr paper", "openreview.net": "openreview paper", "semanticscholar.org": "", "springer.com": "",
}

#: Intents in order of precedence with the phrases that tell them ("conversational" by how a query starts).
INTENTS = {
    "conversational": ["hi", "hello", "hey", "how are you", "what's up", "who are you", "what can you do", "thanks", "thank you", "bye", "goodbye"],
    "debugging": ["error", "bug", "fix", "debug", "exception", "traceback", "why is this failing", "not working", "crash"],
    "procedural": ["how to", "how do i", "steps to", "guide", "tutorial", "walk me through", "set up", "install", "configure", "implement"],
    "comparative": ["vs", "versus", "compare", "difference between", "better than", "pros and cons", "which is", "similarities"],
    "analytical": ["why", "analyze", "explain why", "reason", "impact", "effect", "opinion", "thoughts on", "evaluate", "assess", "implications"],
    "creative": ["write", "generate", "create", "draft", "poem", "story", "essay", "summarize", "rewrite", "paraphrase"],
    "explanatory": ["what is", "what are", "explain", "describe", "tell me about", "define", "meaning of"],
    "factual": ["when", "where", "who", "which", "how many", "how much", "list", "name", "give me"],
}

#: Words in a query that force a web search; verbs that mark a conversational query.
FORCE_WEB = "score vs match playing live news latest currently price stock weather anthropic openai google meta nvidia cricket".split()
INSTRUCTION_VERBS = ["create", "generate", "explain", "what is", "diagram", "write", "detailed"]

#: Dimensions of a judged response and their weights.
JUDGE_WEIGHTS = {
    "relevance": 1.5, "accuracy": 2.0, "completeness": 1.2, "clarity": 1.0, "depth": 1.0, "conciseness": 0.8,
    "helpfulness": 1.3, "factual_grounding": 1.5, "coherence": 1.0, "engagement": 0.7, "safety": 1.0,
}

#: Weight of a resolution in vector retrieval; embedding sizes; similarity thresholds by modality.
RESOLUTION_WEIGHTS = {"fine": 1.0, "mid": 0.85, "coarse": 0.65}
EMBEDDING_SIZES = {"text": 1024, "image": 512, "audio": 1024, "video": 512, "table": 1024, "pdf": 1024, "document": 1024}
SIMILARITY_THRESHOLDS = {"text": 0.5, "image": 0.55, "audio": 0.5, "video": 0.55, "table": 0.5}
#: Fixed value: the threshold of any other modality.
OTHER_THRESHOLD = 0.7


@dataclass(frozen=True)
class RetrievalWeights:
    """Shares of vector, graph, BM25, structural and modality evidence."""

    alpha: float = 0.3
    beta: float = 0.25
    gamma: float = 0.2
    delta: float = 0.15
    epsilon: float = 0.1

    def normalized(self) -> RetrievalWeights:
        parts = (self.alpha, self.beta, self.gamma, self.delta, self.epsilon)
        total = sum(parts)
        return RetrievalWeights(*(p / total for p in parts)) if total > 0 else self

    def updated(self, reward: float, step: float = 0.05) -> RetrievalWeights:
        """A good reward (> 0.7) raises alpha, a bad one (< 0.3) lowers it; then the shares are normalised."""
        shift = step if reward > 0.7 else -step if reward < 0.3 else 0.0
        return RetrievalWeights(min(1.0, max(0.0, self.alpha + shift)), self.beta, self.gamma, self.delta, self.epsilon).normalized()


@dataclass(frozen=True)
class SearchConfig:
    """Limits of a retrieval run."""

    top_k_vector: int = 10
    top_k_graph: int = 10
    top_k_bm25: int = 5
    hops: int = 2
    ppr_alpha: float = 0.15
    ppr_iterations: int = 20
    ppr_tolerance: float = 1e-6
    diversity_lambda: float = 0.25
    confidence: float = 0.5
    mmr_size: int = 20
    context_neighbors: int = 3
