"""Scorer configurations: data instead of builds."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace


# The defaults of the lexical scorer.
@dataclass(frozen=True)
class Config:
    w_lex: float = 0.76
    w_gram3: float = 0.20
    w_gram2: float = 0.04
    f_beta2: float = 0.36
    p_concave: bool = True
    r_key_base: float = 0.5
    r_floor: float = 0.3
    m_contra: float = 0.3
    m_two_faced: float = 0.5
    m_silent: float = 0.95
    b_agree: float = 0.35
    m_num_miss_base: float = 0.62
    m_num_wrong: float = 0.45
    m_num_match: float = 0.0
    m_order: float = 0.55
    m_entity: float = 0.3
    m_negcov: float = 1.0
    sharpen: float = 0.82
    soft_w: float = 1.0
    soft_min: float = 0.72
    soft_cap_frac: float = 0.35
    w_emb: float = 0.0
    step_t: float = 0.0
    step_b: float = 0.02
    step_w: float = 0.0
    step_r: float = 0.0
    tie_src: int = 0
    w_qa: float = 0.0
    emb_a_w: float = 0.0
    emb_l2_w: float = 0.0
    emb_l4_w: float = 0.0
    emb_b_w: float = 1.0
    emb_lex_w: float = 0.0
    gate_lex: float = 0.0
    post_iters: int = 0
    post_pivot: float = 0.5
    post_frac: float = 0.0
    sigk: float = 0.0
    sigc: float = 0.4545
    exact_tie: float = 0.0
    nogt_q: float = 0.0


LEXICAL = Config()
#: No correctness penalties: the base of the embedding blends.
TOPICAL = replace(LEXICAL, m_contra=1.0, m_two_faced=1.0, m_silent=1.0, b_agree=0.0, m_num_miss_base=1.0, m_num_wrong=1.0, m_order=1.0, m_entity=1.0, m_negcov=0.0, sharpen=0.0, w_emb=0.45)
#: Softened penalties on top of the blends.
SOFTENED = replace(TOPICAL, m_contra=0.7, m_two_faced=0.8, m_num_miss_base=0.85, m_num_wrong=0.78, m_order=0.85, m_entity=0.72, m_negcov=0.32)


def merged(base: Config, *overrides: dict) -> Config:
    """``base`` with the overrides applied in order, the last one winning."""
    for values in overrides:
        base = replace(base, **values)
    return base


def grid(base: Config, /, limit: int | None = None, **values) -> list[Config]:
    """The first ``limit`` points of the product of the listed values over ``base``; w_gram2 is what the other two weights
    leave, and points where it is negative or above 0.35 go."""
    out = []
    for point in itertools.product(*values.values()):
        config = replace(base, **dict(zip(values, point)))
        if {"w_lex", "w_gram3"} & set(values):
            rest = round(1 - config.w_lex - config.w_gram3, 10)
            if not 0 <= rest <= 0.35:
                continue
            config = replace(config, w_gram2=rest)
        out.append(config)
    return out[:limit]
