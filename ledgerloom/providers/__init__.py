"""Model providers."""

from ledgerloom.providers.base import CATALOG, DEFAULT_MODEL, PROVIDERS, AnthropicProvider, Completion, ModelNotSupported, OllamaProvider, OpenAIProvider, Provider, StubProvider, make, resolve

__all__ = ["CATALOG", "DEFAULT_MODEL", "PROVIDERS", "AnthropicProvider", "Completion", "ModelNotSupported", "OllamaProvider", "OpenAIProvider", "Provider", "StubProvider", "make", "resolve"]
