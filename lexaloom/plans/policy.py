"""Limits and scores, all in one place; the defaults are the documented ones."""

from __future__ import annotations

from dataclasses import dataclass, field

TIERS = ("exact_title", "title_prefix", "title_phrase", "title_all_tokens", "title_any_token", "keywords_phrase", "keywords_all_tokens", "keywords_any_token", "excerpt_phrase", "excerpt_all_tokens", "excerpt_any_token", "content_phrase", "content_all_tokens", "content_any_token")
_STEPS = (1400, 1300, 1200, 1100, 1000, 900, 850, 800, 700, 650, 600, 500, 450, 400)
PRIORITIES = {"original": 1000, "keyboard": 800, "spelling": 700, "keyboard_spelling": 650, "phonetic": 640, "split": 630, "merge": 620, "keyboard_phonetic": 615, "keyboard_split": 610, "keyboard_merge": 605, "synonym": 600, "contextual": 500, "keyboard_synonym": 400}
SYNONYM_SOURCES = ("synonym", "keyboard_synonym")
REASONS = ("per_variant_limit", "global_candidate_limit", "unexecuted_variants")


@dataclass(frozen=True)
class Policy:
    # queries
    minimum_length: int = 2
    maximum_length: int = 200
    minimum_token_length: int = 1
    maximum_tokens: int = 20
    reject_long: bool = False
    # variants and candidates
    maximum_variants: int = 20
    maximum_terms: int = 10
    per_variant_limit: int = 100
    maximum_candidates: int = 500
    priorities: dict = field(default_factory=lambda: dict(PRIORITIES))
    tier_scores: dict = field(default_factory=lambda: dict(zip(TIERS, _STEPS)))
    # results
    per_page: int = 15
    maximum_per_page: int = 100
    preview_limit: int = 8
    preview_per_type: int = 2
    maximum_groups: int = 50
    bridge: bool = True
    # suggestions
    suggestions: bool = True
    require_exact_window: bool = True
    suggestion_minimum_results: int = 1
    suggestion_minimum_gain: int = 2
    suggestion_minimum_ratio: int = 15000
    # keyboard, synonyms
    keyboard: bool = True
    synonyms: dict = field(default_factory=dict)
    # dictionary
    term_minimum_length: int = 4
    term_maximum_length: int = 64
    minimum_document_frequency: int = 1
    maximum_dictionary_terms: int = 100_000
    deletes_per_term: int = 256
    protected: dict = field(default_factory=dict)
    # spelling
    spelling: bool = False
    options_per_token: int = 5
    rows_per_token: int = 250
    rows_per_query: int = 500
    spelling_variants: int = 5
    inspected_tokens: int = 4
    corrected_tokens: int = 2
    deletes_per_query_token: int = 128
    deletes_per_query: int = 512
    # phonetic and segmentation
    phonetic: bool = False
    phonetic_minimum_length: int = 3
    phonetic_changes: int = 2
    phonetic_alternatives: int = 32
    phonetic_cost: int = 1200
    phonetic_variants: int = 5
    segmentation: bool = False
    split_minimum_length: int = 6
    segment_minimum_length: int = 2
    split_positions: int = 24
    merge_pairs: int = 4
    merges_per_query: int = 1
    segmentation_variants: int = 5
    split_cost: int = 1400
    merge_cost: int = 1500
    lookup_terms: int = 256
    lookup_rows: int = 512
    transformation_depth: int = 2
    # contextual
    contextual: bool = False
    ngrams: bool = True
    ngram_terms: int = 200
    ngrams_per_document: int = 400
    ngram_minimum_frequency: int = 1
    result_counts: bool = True
    auto_apply: bool = False
    maximum_direct_results: int = 3
    context_tokens: int = 5
    context_options: int = 3
    context_candidates: int = 5
    counted_candidates: int = 3
    context_lookups: int = 20
    context_depth: int = 3
    context_rows: int = 300
    context_deletes: int = 512
    count_cap: int = 11
    minimum_confidence: int = 7500
    minimum_result_gain: int = 3
    minimum_result_ratio: int = 30000
    auto_apply_confidence: int = 9000
    auto_apply_needs_zero: bool = True
    minimum_corpus_gain: int = 1
    minimum_context_gain: int = 0

    def __post_init__(self) -> None:
        scores = [self.tier_scores[t] for t in TIERS]
        if scores != sorted(set(scores), reverse=True) or scores[-1] <= 0:
            raise ValueError("tier scores must be positive and fall from tier to tier")
        if not 1 <= self.maximum_variants <= 20 or self.priorities["original"] < max(self.priorities.values()):
            raise ValueError("variant limits or priorities are out of order")

    def protected_terms(self, locale: str) -> set[str]:
        from lexaloom.functions.edit import chain

        return {t for key in ("*", *chain(locale)) for t in self.protected.get(key, ())}


DEFAULT = Policy()
