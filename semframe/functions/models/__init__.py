"""Models behind three roles: embedding, validation and generation."""

from semframe.functions.models.offline import CallableEmbedding, CallableGenerator, CallableValidator, DictionaryEmbedding, EchoGenerator, HashedNgramEmbedding, LetterEmbedding, OverlapValidator
from semframe.functions.models.roles import Embedding, Generator, Validator, with_answers, with_embeddings, with_texts

__all__ = ["CallableEmbedding", "CallableGenerator", "CallableValidator", "DictionaryEmbedding", "EchoGenerator", "Embedding", "Generator", "HashedNgramEmbedding", "LetterEmbedding", "OverlapValidator", "Validator", "with_answers", "with_embeddings", "with_texts"]
