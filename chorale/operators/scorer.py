"""From samples to tokens, for one chunk at a time inside a Python worker: prompts, decoding loops, and a scorer in NumPy.

A scorer is anything with `start(samples, prompt)` giving logits and a state, `step(state, token)` giving logits and a new state
that leaves the old one usable, and optionally `attention(state)`. `TransformerScorer` reads its weights from a parsed model file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from chorale.functions import kernels as K
from chorale.sources.models import Model, values

# Special tokens, and languages in the order of their tokens.
END, START, LANGUAGE, TRANSLATE, TRANSCRIBE, PREVIOUS, NO_SPEECH, NO_TIMESTAMPS, TIMES = 50256, 50258, 50259, 50358, 50359, 50361, 50362, 50363, 50364
LANGUAGES = """en zh de es ru ko fr ja pt tr pl ca nl ar sv it id hi fi vi he uk el ms cs ro da hu ta no th ur hr bg lt la mi ml cy sk te fa
lv bn sr az sl kn et mk br eu is hy ne mn bs kk sq sw gl mr pa si km sn yo so af oc ka be tg sd gu am yi lo uz fo ht ps tk nn mt sa lb my bo
tl mg as tt haw ln ha ba jw su""".split()
MAX_LENGTH = 224


def language_token(code: str) -> int:
    """Unknown codes count as English."""
    return LANGUAGE + (LANGUAGES.index(code) if code in LANGUAGES else 0)


def language_code(token: int) -> str:
    return LANGUAGES[token - LANGUAGE] if 0 <= token - LANGUAGE < len(LANGUAGES) else "en"


@dataclass(frozen=True)
class Options:
    language: str | None = None
    beam_width: int = 1
    temperature: float = 0.0
    top_k: int = 0
    top_p: float = 1.0
    timestamps: bool = False
    initial_prompt: str | None = None
    suppress_tokens: tuple[int, ...] = ()
    no_repeat_ngram_size: int = 0
    compression_ratio_threshold: float = 2.4
    previous_tokens: tuple[int, ...] = ()
    half_cache: bool = False
    translate: bool = False
    fallback_temperatures: tuple[float, ...] = ()
    logprob_threshold: float = -1.0
    word_timestamps: bool = False
    no_speech_threshold: float = 0.6
    suppress_blank: bool = True
    seed: int = 0

    def __post_init__(self):
        for ok, what in (
            (self.beam_width >= 1, "beam_width has to be 1 or more"),
            (self.temperature >= 0, "temperature can't be negative"),
            (0 < self.top_p <= 1, "top_p has to be above 0 and at most 1"),
            (all(t >= 0 for t in self.fallback_temperatures), "fallback temperatures can't be negative"),
            (0 <= self.no_speech_threshold <= 1, "no_speech_threshold has to be between 0 and 1"),
        ):
            if not ok:
                raise ValueError(what)


class Scorer(Protocol):
    vocab: list[str]
    context: int

    def start(self, samples: np.ndarray, prompt: list[int]) -> tuple[np.ndarray, Any]: ...

    def step(self, state: Any, token: int) -> tuple[np.ndarray, Any]: ...


_MADE: dict[str, Scorer] = {}


def made(call: str, make: Callable[[], Scorer]) -> Scorer:
    """The scorer of a call, made once in a worker; that of an earlier call is let go."""
    if call not in _MADE:
        _MADE.clear()
        _MADE[call] = make()
    return _MADE[call]


class PromptEncoder:
    """Greedy longest match over a vocabulary's bytes; a byte that begins no entry is passed over, the first of equal entries counts."""

    def __init__(self, vocab: list[str]):
        self.ids: dict[bytes, int] = {}
        for i, t in enumerate(vocab):
            self.ids.setdefault(t.encode(), i)
        self.ids.pop(b"", None)
        self.longest = max(map(len, self.ids), default=0)

    def __call__(self, text: str) -> list[int]:
        data, out, at = text.encode(), [], 0
        while at < len(data):
            for n in range(min(self.longest, len(data) - at), 0, -1):
                if (i := self.ids.get(data[at : at + n])) is not None:
                    out.append(i)
                    at += n
                    break
            else:
                at += 1
        return out


def build_prompt(language: int, translate: bool, timestamps: bool, before: list[int]) -> list[int]:
    return ([PREVIOUS, *before] if before else []) + [START, language, TRANSLATE if translate else TRANSCRIBE] + ([] if timestamps else [NO_TIMESTAMPS])


def log_softmax(x: np.ndarray) -> np.ndarray:
    most = x.max()
    return x - (most + np.log(np.exp(x - most).sum()))


def argmax_last(x: np.ndarray) -> int:
    return len(x) - 1 - int(x[::-1].argmax())


def is_stop(token: int) -> bool:
    return END <= token < TIMES


def constrain(logits: np.ndarray, done: list[int], o: Options, blank: int | None) -> np.ndarray:
    """Logits with everything at -inf that may not come next."""
    x = logits.astype(np.float64)
    never = -np.inf
    x[[t for t in o.suppress_tokens if t < len(x)]] = never
    if not done and o.suppress_blank:
        x[[t for t in (END, blank) if t is not None and t < len(x)]] = never
    n = o.no_repeat_ngram_size
    if n and len(done) >= n:
        prefix = done[len(done) - n + 1 :] if n > 1 else []
        x[[done[i + n - 1] for i in range(len(done) - n + 1) if done[i : i + n - 1] == prefix]] = never
    if o.timestamps and len(x) > TIMES:
        x[NO_TIMESTAMPS] = never
        if done and done[-1] >= TIMES:
            if len(done) > 1 and done[-2] >= TIMES:
                x[TIMES:] = never
            else:
                x[:TIMES] = never
        marks = [t for t in done if t >= TIMES]
        if marks:
            x[TIMES : min(marks[-1], len(x))] = never
        most = x[TIMES:].max()
        if np.isfinite(most) and most + np.log(np.exp(x[TIMES:] - most).sum()) > x[:TIMES].max():
            x[:TIMES] = never
    return x


def sample(x: np.ndarray, temperature: float, k: int, p: float, rng: np.random.Generator) -> int:
    weights = np.exp((x - x.max()) / max(temperature, 1e-6))
    order = np.lexsort((np.arange(len(x)), -weights))[: k or None]
    weights = weights[order]
    if p < 1:
        cut = int(np.searchsorted(np.cumsum(weights / weights.sum()), p)) + 1
        order, weights = order[:cut], weights[:cut]
    return int(order[min(int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum())), len(order) - 1)])


@dataclass
class Decoded:
    tokens: list[int] = field(default_factory=list)
    logprobs: list[float] = field(default_factory=list)
    no_speech: float = 0.0
    attention: list[np.ndarray] = field(default_factory=list)

    @property
    def mean(self) -> float:
        return float(np.mean(self.logprobs)) if self.logprobs else 0.0


def _row(scorer: Scorer, state: Any, o: Options) -> list[np.ndarray]:
    return [scorer.attention(state)] if o.word_timestamps and hasattr(scorer, "attention") else []


def decode_one(scorer: Scorer, logits: np.ndarray, state: Any, at: int, o: Options, blank: int | None, pick: Callable[[np.ndarray], int]) -> Decoded:
    """One sequence, a token at a time, by pick; it ends at a stop token, at MAX_LENGTH or at the end of the context."""
    out = Decoded(no_speech=float(np.exp(log_softmax(logits)[NO_SPEECH])) if len(logits) > NO_SPEECH else 0.0)
    while len(out.tokens) < MAX_LENGTH and at <= scorer.context:
        x = constrain(logits, out.tokens, o, blank)
        if not np.isfinite(x.max()):
            break
        token = pick(x)
        if is_stop(token):
            break
        out.tokens.append(token)
        out.logprobs.append(float(log_softmax(x)[token]))
        out.attention += _row(scorer, state, o)
        logits, state = scorer.step(state, token)
        at += 1
    return out


def decode_beam(scorer: Scorer, logits: np.ndarray, state: Any, at: int, o: Options, blank: int | None) -> Decoded:
    """The best of beam_width sequences by score over length ** 0.6; finished ones stay in the race."""
    silent = float(np.exp(log_softmax(logits)[NO_SPEECH])) if len(logits) > NO_SPEECH else 0.0
    best = lambda lp, n: np.lexsort((np.arange(len(lp)), -lp))[:n]
    rank = lambda b: b[1] / max(len(b[0]), 1) ** 0.6
    lp = log_softmax(constrain(logits, [], o, blank))
    seeds = [int(t) for t in best(lp, max(2 * o.beam_width, o.beam_width + 4)) if not is_stop(int(t)) and np.isfinite(lp[t])][: o.beam_width]
    beams = [([t], float(lp[t]), [float(lp[t])], state, _row(scorer, state, o), False) for t in seeds]
    for k in range(MAX_LENGTH):
        if all(b[-1] for b in beams):
            break
        found = []
        for tokens, score, probs, held, seen, done in beams:
            if done:
                found.append((tokens, score, probs, held, seen, True))
                continue
            logits, new = scorer.step(held, tokens[-1])
            lp, row = log_softmax(constrain(logits, tokens, o, blank)), _row(scorer, new, o)
            for t in map(int, best(lp, o.beam_width)):
                ends = is_stop(t) or at + k + 1 >= scorer.context
                found.append((tokens if ends else [*tokens, t], score + float(lp[t]), probs if ends else [*probs, float(lp[t])], new, seen if ends else seen + row, ends))
        beams = sorted(found, key=rank, reverse=True)[: o.beam_width]
    if not beams:
        return Decoded(no_speech=silent)
    tokens, _, probs, _, seen, _ = max(beams, key=rank)
    return Decoded(tokens, probs, silent, seen)


def text_of(tokens: list[int], vocab: list[str]) -> str:
    return "".join(vocab[t] for t in tokens if t < len(vocab) and not vocab[t].startswith("<|"))


def repeated(text: str, threshold: float) -> bool:
    if threshold <= 0 or len(text.encode()) < 10:
        return False
    _, n = np.unique(list(text), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum()) < 8 / threshold


def transcribe(scorer: Scorer, samples: np.ndarray, o: Options, before: list[int] | None = None) -> tuple[Decoded, str]:
    """Tokens of a chunk and its language; a silent chunk has no tokens."""
    encode = PromptEncoder(scorer.vocab) if o.initial_prompt else None
    context = [*(before or o.previous_tokens), *(encode(o.initial_prompt) if encode else [])]
    if o.language:
        language = language_token(o.language)
    else:
        logits, _ = scorer.start(samples, [START])
        some = logits[LANGUAGE : LANGUAGE + len(LANGUAGES)]
        language = LANGUAGE + (int(some.argmax()) if len(some) else 0)
    prompt = build_prompt(language, o.translate, o.timestamps, context)
    blank = scorer.vocab.index(" ") if " " in scorer.vocab else None
    out = Decoded()
    for k, t in enumerate(o.fallback_temperatures or (o.temperature,)):
        logits, state = scorer.start(samples, prompt)
        if t > 0:
            rng = np.random.default_rng([o.seed, k])
            out = decode_one(scorer, logits, state, len(prompt), o, blank, lambda x: sample(x, t, o.top_k, o.top_p, rng))  # noqa: B023
        elif o.beam_width > 1:
            out = decode_beam(scorer, logits, state, len(prompt), o, blank)
        else:
            out = decode_one(scorer, logits, state, len(prompt), o, blank, argmax_last)
        if not out.tokens or not (repeated(text_of(out.tokens, scorer.vocab), o.compression_ratio_threshold) or out.mean < o.logprob_threshold):
            break
    if out.tokens and out.no_speech > o.no_speech_threshold and out.mean < o.logprob_threshold:
        out = Decoded(no_speech=out.no_speech)
    return out, language_code(language)


class TransformerScorer:
    """An encoder-decoder over log-mel frames; matrices may stay in quantized blocks until they are used."""

    def __init__(self, model: Model, half_cache: bool = False):
        self.vocab, self.context, self.half = model.vocab, model.hparams["n_text_ctx"], half_cache
        self.h, self.model, self.filters = model.hparams, model, model.filters

    def tensor(self, name: str) -> np.ndarray:
        shape, kind, raw = self.model.tensors[name]
        return values(shape, kind, raw).reshape(shape[::-1])  # files list the innermost dimension first

    def _linear(self, x: np.ndarray, name: str, bias: bool = True) -> np.ndarray:
        return K.linear(x, self.tensor(f"{name}.weight"), self.tensor(f"{name}.bias") if bias else None)

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return K.layer_norm(x, self.tensor(f"{name}.weight"), self.tensor(f"{name}.bias"))

    def _mlp(self, x: np.ndarray, block: str) -> np.ndarray:
        return self._linear(K.gelu(self._linear(self._norm(x, f"{block}.mlp_ln"), f"{block}.mlp.0")), f"{block}.mlp.2")

    def encode(self, samples: np.ndarray) -> np.ndarray:
        x = K.log_mel(samples, np.asarray(self.filters, np.float32).reshape(self.h["n_mels"], -1))
        x = K.gelu(K.conv1d(x, self.tensor("encoder.conv1.weight"), self.tensor("encoder.conv1.bias").ravel()))
        x = K.gelu(K.conv1d(x, self.tensor("encoder.conv2.weight"), self.tensor("encoder.conv2.bias").ravel(), stride=2)).T[: self.h["n_audio_ctx"]]
        x = x + self.tensor("encoder.positional_embedding")[: len(x)]
        for i in range(self.h["n_audio_layer"]):
            b = f"encoder.blocks.{i}"
            y = self._norm(x, f"{b}.attn_ln")
            q, k, v = self._linear(y, f"{b}.attn.query"), self._linear(y, f"{b}.attn.key", False), self._linear(y, f"{b}.attn.value")
            x = x + self._linear(K.attention(q, k, v, self.h["n_audio_head"])[0], f"{b}.attn.out")
            x = x + self._mlp(x, b)
        return self._norm(x, "encoder.ln_post")

    @property
    def width(self) -> int:
        """Of a frame that encode gives."""
        return self.h["n_audio_state"]

    def start(self, samples: np.ndarray, prompt: list[int]) -> tuple[np.ndarray, Any]:
        audio = self.encode(samples)
        layers = range(self.h["n_text_layer"])
        cross = [(self._linear(audio, f"decoder.blocks.{i}.cross_attn.key", False), self._linear(audio, f"decoder.blocks.{i}.cross_attn.value")) for i in layers]
        caches = [K.KeyValueCache(self.context + 1, self.h["n_text_state"], self.half) for _ in layers]
        return self._forward(prompt, 0, caches, cross)

    def step(self, state: Any, token: int) -> tuple[np.ndarray, Any]:
        at, caches, cross, _ = state
        return self._forward([token], at, [c.copy() for c in caches], cross)

    def attention(self, state: Any) -> np.ndarray:
        """The last position's weights over the audio, of the upper half of layers."""
        return state[3]

    def _forward(self, tokens: list[int], at: int, caches: list, cross: list) -> tuple[np.ndarray, Any]:
        embedding, heads = self.tensor("decoder.token_embedding.weight"), self.h["n_text_head"]
        x = embedding[np.minimum(tokens, len(embedding) - 1)] + self.tensor("decoder.positional_embedding")[at : at + len(tokens)]
        seen = []
        for i, (cache, (ck, cv)) in enumerate(zip(caches, cross)):
            b = f"decoder.blocks.{i}"
            y = self._norm(x, f"{b}.attn_ln")
            k, v = cache.append(self._linear(y, f"{b}.attn.key", False), self._linear(y, f"{b}.attn.value"))
            x = x + self._linear(K.attention(self._linear(y, f"{b}.attn.query"), k, v, heads, K.causal_mask(len(tokens), at))[0], f"{b}.attn.out")
            y, weights = K.attention(self._linear(self._norm(x, f"{b}.cross_attn_ln"), f"{b}.cross_attn.query"), ck, cv, heads)
            x = x + self._linear(y, f"{b}.cross_attn.out")
            if i in K.alignment_layers(len(caches)):
                seen.append(weights[-1])
            x = x + self._mlp(x, b)
        return self._norm(x[-1:], "decoder.ln")[0] @ embedding.T, (at + len(tokens), caches, cross, np.mean(seen, axis=0))
