"""A small TypeScript project: lending books, with aliases, barrels, types, methods and tests."""

FILES = {
    "src/model/book.ts": """export interface Titled {
  title: string;
}

export interface Book extends Titled {
  isbn: string;
  copies: number;
}
""",
    "src/rules/rule.ts": """import type { Book } from "../model/book";

export interface Rule {
  days(book: Book): number;
}
""",
    "src/rules/standard.ts": """import type { Book } from "../model/book";
import type { Rule } from "./rule";

const LENGTHS: Record<string, number> = { short: 7, long: 28 };

/** Loan length by number of copies. */
export class StandardRule implements Rule {
  days(book: Book): number {
    return loanLength(book);
  }
}

export function loanLength(book: Book): number {
  const kind = book.copies > 1 ? "long" : "short";
  return Math.max(1, LENGTHS[kind] ?? 0);
}
""",
    "src/rules/index.ts": """export { loanLength as lengthOf, StandardRule } from "./standard";
export * from "./rule";
""",
    "src/lend.ts": """import { lengthOf, type Rule } from "./rules";
import type { Book } from "./model/book";
import * as log from "./log";

export const lend = (book: Book): number => {
  const days = lengthOf(book);
  log.record(`lent ${book.title} for ${String(days)} days (not lend())`);
  return days;
};
export type Lender = typeof lend;
""",
    "src/log.ts": """const entries: string[] = [];
export function record(text: string): void { entries.push(text); }
export default function clear(): void { entries.length = 0; }
""",
    "src/desk.ts": """import { lend } from "./lend";
import reset from "./log.js";
import type { Book } from "./model/book";

export abstract class Counter {
  protected count = 0;
  bump(): void { this.count += 1; }
  abstract close(): void;
}

export class Desk extends Counter {
  constructor(private readonly books: Book[]) { super(); }
  async checkout(book: Book) {
    this.bump();
    return lend(book);
  }
  close(): void { reset(); }
}
""",
    "src/settings.ts": "export const settings = { maximumLoans: 5 };\n",
    "types/globals.d.ts": "declare interface Shelf { place(): void; }\n",
    "tests/rules.spec.ts": """import { StandardRule } from "../src/rules/standard";
import type { Rule } from "../src/rules/rule";

export function standardKeepsRule(): void {
  const rule: Rule = new StandardRule();
  if (rule.days({ title: "t", isbn: "1", copies: 2 }) !== 28) throw new Error("wrong length");
}
""",
    "tests/desk.test.ts": """import * as desk from "../src/desk";
import { expect } from "chai";

export async function deskLends() {
  const counter = new desk.Desk([]);
  expect(1).to.equal(1);
}
""",
}

# Worked out by hand from the sources above.
SYMBOLS = {
    ("src/model/book.ts", "Titled", "interface"), ("src/model/book.ts", "Book", "interface"),
    ("src/rules/rule.ts", "Rule", "interface"),
    ("src/rules/standard.ts", "StandardRule", "class"), ("src/rules/standard.ts", "StandardRule.days", "method"),
    ("src/rules/standard.ts", "loanLength", "function"),
    ("src/lend.ts", "lend", "function-variable"), ("src/lend.ts", "Lender", "type"),
    ("src/log.ts", "record", "function"), ("src/log.ts", "clear", "function"),
    ("src/desk.ts", "Counter", "class"), ("src/desk.ts", "Counter.bump", "method"),
    ("src/desk.ts", "Desk", "class"), ("src/desk.ts", "Desk.constructor", "constructor"),
    ("src/desk.ts", "Desk.checkout", "method"), ("src/desk.ts", "Desk.close", "method"),
    ("types/globals.d.ts", "Shelf", "interface"),
    ("tests/rules.spec.ts", "standardKeepsRule", "function"), ("tests/desk.test.ts", "deskLends", "function"),
}
IMPORTS = {
    ("src/rules/rule.ts", "src/model/book.ts"), ("src/rules/standard.ts", "src/model/book.ts"),
    ("src/rules/standard.ts", "src/rules/rule.ts"), ("src/lend.ts", "src/rules/index.ts"),
    ("src/lend.ts", "src/model/book.ts"), ("src/lend.ts", "src/log.ts"), ("src/desk.ts", "src/lend.ts"),
    ("src/desk.ts", "src/log.ts"), ("src/desk.ts", "src/model/book.ts"),
    ("tests/rules.spec.ts", "src/rules/standard.ts"), ("tests/rules.spec.ts", "src/rules/rule.ts"),
    ("tests/desk.test.ts", "src/desk.ts"),
}
CALLS = {
    ("StandardRule.days", "loanLength"), ("lend", "loanLength"), ("lend", "record"), ("Desk.checkout", "Counter.bump"),
    ("Desk.checkout", "lend"), ("Desk.close", "clear"), ("standardKeepsRule", "Rule"),
}
# A namespace import has no names, so its test covers every symbol of the file.
TESTS = {
    ("tests/rules.spec.ts", "StandardRule"), ("tests/rules.spec.ts", "Rule"),
    ("tests/desk.test.ts", "Counter"), ("tests/desk.test.ts", "Counter.bump"), ("tests/desk.test.ts", "Desk"),
    ("tests/desk.test.ts", "Desk.constructor"), ("tests/desk.test.ts", "Desk.checkout"), ("tests/desk.test.ts", "Desk.close"),
}
EXTENDS = {("Book", "Titled"), ("Desk", "Counter")}
IMPLEMENTS = {("StandardRule", "Rule")}
