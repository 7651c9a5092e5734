"""Real models, where their libraries or servers are at hand.

Nothing is imported before a model is first used; each worker process loads its
model once.  On a cluster with GPUs give every model its own stage and ask for
one GPU a task (``spark.task.resource.gpu.amount``)."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

import numpy as np

from semframe.functions.models.roles import Embedding, Generator, Validator
from semframe.memo import memo

_SYSTEM = "Answer with one word, yes or no."


@memo
def _sentence_model(path: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(path)


@memo
def _transformer(path: str, causal: bool):
    import torch
    from transformers import AutoModel, AutoModelForCausalLM, AutoTokenizer

    device = "cuda" if torch.cuda.is_available() else "cpu"
    kind = AutoModelForCausalLM if causal else AutoModel
    return AutoTokenizer.from_pretrained(path), kind.from_pretrained(path).to(device).eval(), device


class SentenceEmbedding(Embedding):
    """A sentence encoder: pooled and at length 1, so the inner product is the
    cosine."""

    def __init__(self, path: str = "sentence-transformers/all-mpnet-base-v2", size: int = 768):
        self.path, self.size = path, size

    def embed(self, texts: list[str]) -> np.ndarray:
        return _sentence_model(self.path).encode(texts, normalize_embeddings=True)


class PooledEmbedding(Embedding):
    """Mean of the last hidden layer of any encoder, not normalised; with
    ``padding_too`` the mean runs over padding as well."""

    def __init__(self, path: str = "intfloat/e5-base-v2", size: int = 768, max_tokens: int = 512, padding_too: bool = False):
        self.path, self.size, self.max_tokens, self.padding_too = path, size, max_tokens, padding_too

    def embed(self, texts: list[str]) -> np.ndarray:
        import torch

        coder, model, device = _transformer(self.path, False)
        if coder.pad_token is None:
            coder.pad_token = coder.eos_token
        given = coder(texts, padding=True, truncation=True, max_length=self.max_tokens, return_tensors="pt").to(device)
        with torch.no_grad():
            hidden = model(**given).last_hidden_state
        mask = torch.ones_like(given["attention_mask"]) if self.padding_too else given["attention_mask"]
        weights = mask.unsqueeze(-1).to(hidden.dtype)
        return ((hidden * weights).sum(1) / weights.sum(1)).float().cpu().numpy()


class LocalChat:
    """A causal model with a chat template."""

    def __init__(self, path: str = "meta-llama/Llama-3.2-3B-Instruct"):
        self.path = path

    def answer(self, prompt: str, system_prompt: str | None, tokens: int, temperature: float) -> str:
        import torch

        coder, model, device = _transformer(self.path, True)
        talk = ([{"role": "system", "content": system_prompt}] if system_prompt else []) + [{"role": "user", "content": prompt}]
        given = coder.apply_chat_template(talk, add_generation_prompt=True, return_tensors="pt").to(device)
        options = {"do_sample": True, "temperature": temperature} if temperature > 0 else {"do_sample": False}
        with torch.no_grad():
            out = model.generate(given, max_new_tokens=tokens, **options)
        return coder.decode(out[0][given.shape[1] :], skip_special_tokens=True).strip()


class ServerChat:
    """A chat server with the common ``/v1/chat/completions`` interface; waits
    and asks again ``retries`` times where it is over its quota."""

    def __init__(self, url: str, model: str, key: str = "", retries: int = 5, wait: float = 60.0):
        self.url, self.model, self.key, self.retries, self.wait = url, model, key, retries, wait

    def answer(self, prompt: str, system_prompt: str | None, tokens: int, temperature: float) -> str:
        talk = ([{"role": "system", "content": system_prompt}] if system_prompt else []) + [{"role": "user", "content": prompt}]
        body = json.dumps({"model": self.model, "messages": talk, "max_tokens": tokens, "temperature": temperature}).encode()
        for turn in range(self.retries + 1):
            try:
                asked = urllib.request.Request(self.url, body, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
                with urllib.request.urlopen(asked, timeout=600) as told:
                    return json.load(told)["choices"][0]["message"]["content"].strip()
            except urllib.error.HTTPError as e:
                if e.code != 429 or turn == self.retries:
                    raise
                time.sleep(self.wait)
        raise AssertionError


class ChatValidator(Validator):
    """Yes or no from a chat model: the whole answer or, with ``ending``, its
    last word (for models that think aloud) must be yes."""

    def __init__(self, chat: LocalChat | ServerChat, system_prompt: str = _SYSTEM, ending: bool = False, tokens: int = 3):
        self.chat, self.system_prompt, self.ending, self.tokens = chat, system_prompt, ending, 4096 if ending else tokens

    def __call__(self, prompt: str, system_prompt: str | None = None) -> bool:
        told = self.chat.answer(prompt, system_prompt or self.system_prompt, self.tokens, 0.0).lower().strip(" .!\n")
        return told.endswith("yes") if self.ending else told == "yes"


class ChatGenerator(Generator):
    """Text from a chat model, in lower case where asked for."""

    def __init__(self, chat: LocalChat | ServerChat, lower: bool = False):
        self.chat, self.lower = chat, lower

    def __call__(self, prompt: str, system_prompt: str | None = None, max_new_tokens: int = 100, temperature: float = 0.7) -> str:
        told = self.chat.answer(prompt, system_prompt, max_new_tokens, temperature)
        return told.lower() if self.lower else told
