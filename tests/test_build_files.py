"""Gradle modules, npm workspaces and tsconfig aliases of small builds."""

import pytest

from strandline.sources import build_files as B

SETTINGS = """rootProject.name = "x" // include ':no'
include ':app', ":lib-core"
include(
    ":feature:my_ui", // include(":comment")
    "data"
)
/* include ':gone' */
def url = "http://a//b"; include "after"
"""
APP = """plugins { id 'x' }
dependencies {
    implementation project(':lib-core')
    api(platform(project(path: ":data")))
    testImplementation(testFixtures(projects.feature.myUi)) { because("x") }
    // implementation project(':after')
    implementation(projects.noSuch)
    debug { project(":missing") }  // the word before it on its line is followed by a bracket
    implementation project(":app")
    implementation project(':lib-core')
}
"""


def rows_of(spark, files):
    return B.extract(spark.createDataFrame(list(files.items()), "path string, content string")).cache()


def test_a_gradle_build(spark):
    rows = rows_of(spark, {"settings.gradle": SETTINGS, "app/build.gradle": APP, "app/build.gradle.kts": APP, "lib-core/build.gradle.kts": "val a = project\n(':data')\napi(project(\":data\"))", "other/build.gradle": "api project(':app')"})
    modules = {r.module: (r.dir, r.file) for r in B.gradle_modules(rows).collect()}
    assert modules == {":": ("", None), ":app": ("app", "app/build.gradle.kts"), ":lib-core": ("lib-core", "lib-core/build.gradle.kts"), ":feature:my_ui": ("feature/my_ui", None), ":data": ("data", None), ":after": ("after", None)}
    got = sorted((r.from_id[20:], r.to_id[20:], r.configuration, r.resolution, r.line) for r in B.gradle_relations(rows).collect())
    assert got == [
        (":app", ":data", "api", "exact", 4),
        (":app", ":feature:my_ui", "testImplementation", "exact", 5),
        (":app", ":lib-core", "implementation", "exact", 3),
        (":app", "projects.noSuch", "implementation", "unresolved", 7),
        (":lib-core", ":data", "api", "exact", 3),
    ]
    assert all(r.relation == "DECLARES_DEPENDENCY" and r.confidence == "static_certain" for r in B.gradle_relations(rows).collect())


def test_without_settings_each_folder_with_a_script_is_a_module(spark):
    rows = rows_of(spark, {"build.gradle": "", "a/b/build.gradle": "api project(':')\napi project(':a:c')", "a/c/build.gradle.kts": ""})
    assert {r.module for r in B.gradle_modules(rows).collect()} == {":", ":a:b", ":a:c"}
    assert {(r.from_id, r.to_id) for r in B.gradle_relations(rows).collect()} == {("build-module:gradle::a:b", "build-module:gradle::a:c")}


def test_comments_keep_offsets():
    text = "a // b ' c\n\"// no\" 'it\\'s /*' /* x\n y */ z // \"\n\"open // in\nq /* never"
    got = B.without_comments(text)
    assert len(got) == len(text) and got.split("\n") == ["a         ", "\"// no\" 'it\\'s /*'     ", "      z     ", '"open // in', "q         "]


NPM = {
    "package.json": '{"name": "root", "workspaces": {"packages": ["./packages/*", "apps/**", "!apps/**/skip", ""]}, "devDependencies": {"@x/a": "1", "left-pad": "1"}}',
    "packages/a/package.json": '{"name": "@x/a",\n "dependencies": {\n  "b": "1", "@x/a": "1"},\n "peerDependencies": {"b": "2"}}',
    "packages/b/package.json": '{"name": "b"}',
    "packages/b2/package.json": '{"name": "b", "dependencies": {"root": "1"}}',
    "packages/deep/er/package.json": '{"name": "deep"}',
    "apps/package.json": '{"name": "apps"}',
    "apps/web/site/package.json": '{"name": "web", "optionalDependencies": {"deep": "1", "b": "1", "apps": "1"}}',
    "apps/x/skip/package.json": '{"name": "skip"}',
    "packages/bad/package.json": "{",
    "packages/noname/package.json": "[]",
}


def test_npm_workspaces(spark):
    rows = rows_of(spark, NPM)
    assert {r.id: r.dir for r in B.npm_modules(rows).collect()} == {"root": "", "@x/a": "packages/a", "b": "packages/b", "packages/b2": "packages/b2", "apps": "apps", "web": "apps/web/site", "packages/bad": "packages/bad", "packages/noname": "packages/noname"}
    got = sorted((r.from_id[17:], r.to_id[17:], r.configuration, r.line) for r in B.npm_relations(rows).collect())
    assert got == [("@x/a", "b", "dependencies", 3), ("@x/a", "b", "peerDependencies", 4), ("packages/b2", "root", "dependencies", 1), ("root", "@x/a", "devDependencies", 1), ("web", "apps", "optionalDependencies", 1), ("web", "b", "optionalDependencies", 1)]
    assert B.npm_modules(rows_of(spark, {"package.json": '{"name": "x"}', "a/package.json": "{}"})).count() == 0


TSCONFIG = '\ufeff{ // c\n "compilerOptions": { "baseUrl": "./src", "paths": { "@app/*": ["x/*",], "@app/deep/*": [], "exact": [], "*": ["any"], "a//b/*": [], }, /* , } */ }, }'


def test_aliases_by_the_longest_prefix(spark):
    rows = rows_of(spark, {"tsconfig.json": TSCONFIG, "x/tsconfig.base.json": '{"a" 1}', "y/tsconfig.json": '{"compilerOptions": {"paths": []}}'})
    assert {r.path for r in rows.where("row = 'failed'").collect()} == {"x/tsconfig.base.json", "y/tsconfig.json"}
    sources = spark.createDataFrame([("src/pages/a.ts",), ("src/main.test.ts",), ("lib/z.ts",), ("src/.env",)], "path string")
    known = B.aliases(rows, sources)
    assert {(r.kind, r.key) for r in known.collect()} == {("prefix", "@app/"), ("prefix", "@app/deep/"), ("exact", "exact"), ("prefix", "a//b/"), ("root", "pages"), ("root", "main.test"), ("root", ".env")}
    said = {"@app/deep/q": "@app/deep/", "@app/q": "@app/", "exact": "exact", "exact/x": None, "pages/b": "pages", "lib/z": None, "react": None, "a//b/c": "a//b/", None: None, "": None}
    got = B.with_alias(spark.createDataFrame([(s,) for s in said], "specifier string"), known).collect()
    assert {r.specifier: r.alias for r in got} == said and len(got) == len(said)


@pytest.mark.parametrize(("text", "value"), [('{"a": "// no, }", // x\n "b": [1, 2, ], }', {"a": "// no, }", "b": [1, 2]}), ('/* a */ [ /* ] */ 1,\n]', [1])])
def test_tolerant_json(text, value):
    assert B.tolerant_json(text) == value
