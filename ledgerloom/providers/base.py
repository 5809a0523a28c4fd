"""Providers are made inside the worker, one a partition; a failing call is a result, never an exception."""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

MAX_TOKENS, TEMPERATURE = 2048, 0.0
DEFAULT_MODEL = "claude-haiku"
#: The models known by name: provider, the provider's id, whether it reads images. Prices come with a table of models.
CATALOG = {
    "claude-haiku": ("anthropic", "claude-3-haiku-20240307", True), "claude-haiku-4": ("anthropic", "claude-haiku-4-5-20251001", True), "claude-sonnet": ("anthropic", "claude-sonnet-4-5-20250929", True),
    "claude-sonnet-3.7": ("anthropic", "claude-3-7-sonnet-20250219", True), "claude-opus": ("anthropic", "claude-opus-4-5-20251101", True),
    "gpt-4o": ("openai", "gpt-4o", True), "gpt-4o-mini": ("openai", "gpt-4o-mini", True), "gpt-4-turbo": ("openai", "gpt-4-turbo", True), "gpt-4": ("openai", "gpt-4", False),
    "llama3": ("ollama", "llama3:latest", False), "llama3.2": ("ollama", "llama3.2:latest", False), "mistral": ("ollama", "mistral:latest", False), "llava": ("ollama", "llava:latest", True), "llava-llama3": ("ollama", "llava-llama3:latest", True),
}


class ModelNotSupported(ValueError):
    """A model that no catalog and no local form of name knows."""


@dataclass
class Completion:
    success: bool
    content: str = ""
    input_tokens: int = 0
    output_tokens: int = 0
    model: str = ""
    error: str | None = None
    metadata: dict = field(default_factory=dict)

    @property
    def total_tokens(self) -> int:
        return self.input_tokens + self.output_tokens


@runtime_checkable
class Provider(Protocol):
    name: str
    model_id: str
    vision: bool

    def ask(self, prompt: str, image: bytes | None = None, media_type: str = "image/jpeg") -> Completion: ...


class _Remote:
    """What the adapters share: the model's row, the guarded call and the vision gate."""

    name = ""
    #: Environment variable of the key, and whose key it is; none for a local model.
    key: tuple[str, str] | None = None

    def __init__(self, model: str, model_id: str, vision: bool, api_key: str | None = None, base_url: str | None = None):
        self.model, self.model_id, self.vision, self.base_url = model, model_id, vision, base_url
        self.api_key = _key(self.key[0], api_key, self.key[1]) if self.key else api_key

    def info(self) -> dict:
        return {"name": self.model, "id": self.model_id, "provider": self.name, "supports_vision": self.vision}

    def ask(self, prompt: str, image: bytes | None = None, media_type: str = "image/jpeg") -> Completion:
        if image is not None and not self.vision:
            return Completion(False, model=self.model_id, error=f"Model {self.model} does not support vision")
        try:
            encoded = base64.standard_b64encode(image).decode("ascii") if image is not None else None
            return self._send(prompt, encoded, media_type)
        except Exception as e:  # noqa: BLE001 - any failure of the SDK is a failed call
            return Completion(False, model=self.model_id, error=str(e))

    def _send(self, prompt: str, image: str | None, media_type: str) -> Completion:
        raise NotImplementedError


def _key(name: str, given: str | None, owner: str) -> str:
    key = given or os.environ.get(name)
    if not key:  # Fixed values: the text of the failure
        raise ValueError(f"{owner} API key required. Set {name} env var or pass api_key.")
    return key


class AnthropicProvider(_Remote):
    name = "anthropic"
    key = ("ANTHROPIC_API_KEY", "Anthropic")

    def _send(self, prompt, image, media_type):
        import anthropic

        content = [{"type": "text", "text": prompt}]
        if image is not None:
            content.insert(0, {"type": "image", "source": {"type": "base64", "media_type": media_type, "data": image}})
        client = anthropic.Anthropic(api_key=self.api_key, base_url=self.base_url)
        r = client.messages.create(model=self.model_id, max_tokens=MAX_TOKENS, temperature=TEMPERATURE, messages=[{"role": "user", "content": content if image is not None else prompt}])
        return Completion(True, r.content[0].text, r.usage.input_tokens, r.usage.output_tokens, self.model_id, metadata={"stop_reason": r.stop_reason})


class OpenAIProvider(_Remote):
    name = "openai"
    key = ("OPENAI_API_KEY", "OpenAI")

    def _send(self, prompt, image, media_type):
        import openai

        content = prompt if image is None else [{"type": "image_url", "image_url": {"url": f"data:{media_type};base64,{image}"}}, {"type": "text", "text": prompt}]
        client = openai.OpenAI(api_key=self.api_key, base_url=self.base_url)
        r = client.chat.completions.create(model=self.model_id, max_tokens=MAX_TOKENS, temperature=TEMPERATURE, messages=[{"role": "user", "content": content}])
        used = r.usage
        return Completion(True, r.choices[0].message.content or "", used.prompt_tokens if used else 0, used.completion_tokens if used else 0, self.model_id, metadata={"finish_reason": r.choices[0].finish_reason})


class OllamaProvider(_Remote):
    name = "ollama"

    def _send(self, prompt, image, media_type):
        import ollama

        client = ollama.Client(host=self.base_url) if self.base_url else ollama.Client()
        r = client.generate(model=self.model_id, prompt=prompt, stream=False, options={"temperature": TEMPERATURE, "num_predict": MAX_TOKENS}, **({"images": [image]} if image is not None else {}))
        return Completion(True, r.get("response", ""), r.get("prompt_eval_count") or 0, r.get("eval_count") or 0, self.model_id, metadata={"total_duration": r.get("total_duration")})

    def local_models(self) -> list[str]:
        try:
            import ollama

            return [m["name"] for m in ollama.list().get("models", [])]
        except Exception:  # noqa: BLE001 - no server, no models
            return []


class StubProvider:
    """Answers by a function of the prompt; tokens are characters over four."""

    name = "stub"

    def __init__(self, answer, vision: bool = True, model_id: str = "stub-1"):
        self.answer, self.vision, self.model_id = answer, vision, model_id

    def ask(self, prompt: str, image: bytes | None = None, media_type: str = "image/jpeg") -> Completion:
        if image is not None and not self.vision:
            return Completion(False, model=self.model_id, error=f"Model {self.model_id} does not support vision")
        try:
            text = self.answer(prompt)
        except Exception as e:  # noqa: BLE001
            return Completion(False, model=self.model_id, error=str(e))
        return Completion(True, text, len(prompt) // 4, len(text) // 4, self.model_id)


PROVIDERS = {p.name: p for p in (AnthropicProvider, OpenAIProvider, OllamaProvider)}


def resolve(model: str, catalog: dict[str, tuple[str, str, bool]]) -> tuple[str, str, bool]:
    """``(provider, model_id, vision)``: from the catalog, else a local model by its name's form."""
    if model in catalog:
        return catalog[model]
    if ":" in model or model.startswith(("llama", "mistral")):
        return "ollama", model if ":" in model else f"{model}:latest", True
    raise ModelNotSupported(f"Unknown model: {model}. Available: {sorted(catalog)}")


def make(model: str, catalog: dict[str, tuple[str, str, bool]], api_key: str | None = None, base_url: str | None = None) -> Provider:
    provider, model_id, vision = resolve(model, catalog)
    return PROVIDERS[provider](model, model_id, vision, api_key, base_url)
