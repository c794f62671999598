"""Rule packs: the word lists and patterns that the text operators take as arguments."""

from colloquy.packs.base import DuePhrase, RulePack, TaskPattern
from colloquy.packs.prose import PROSE
from colloquy.packs.zh import ZH

__all__ = ["DuePhrase", "PROSE", "RulePack", "TaskPattern", "ZH"]
