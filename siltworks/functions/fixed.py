"""Prefixes, coordinates and words that results depend on, in their order of precedence."""

#: Library dimension: package prefix, group, artifact, version.
LIBRARIES = (
    ("androidx.core", "androidx.core", "core-ktx", "1.12.0"),
    ("androidx.appcompat", "androidx.appcompat", "appcompat", "1.6.1"),
    ("com.google.android.material", "com.google.android.material", "material", "1.11.0"),
    ("androidx.constraintlayout", "androidx.constraintlayout", "constraintlayout", "2.1.4"),
    ("androidx.recyclerview", "androidx.recyclerview", "recyclerview", "1.3.2"),
    ("androidx.fragment", "androidx.fragment", "fragment-ktx", "1.6.2"),
    ("androidx.lifecycle", "androidx.lifecycle", "lifecycle-runtime-ktx", "2.7.0"),
    ("androidx.navigation", "androidx.navigation", "navigation-fragment-ktx", "2.7.6"),
    ("androidx.room", "androidx.room", "room-runtime", "2.6.1"),
    ("androidx.datastore", "androidx.datastore", "datastore-preferences", "1.0.0"),
    ("androidx.work", "androidx.work", "work-runtime-ktx", "2.9.0"),
    ("androidx.camera", "androidx.camera", "camera-core", "1.3.1"),
    ("androidx.biometric", "androidx.biometric", "biometric", "1.1.0"),
    ("androidx.security", "androidx.security", "security-crypto", "1.1.0-alpha06"),
    ("androidx.viewpager2", "androidx.viewpager2", "viewpager2", "1.0.0"),
    ("androidx.swiperefreshlayout", "androidx.swiperefreshlayout", "swiperefreshlayout", "1.1.0"),
    ("retrofit2", "com.squareup.retrofit2", "retrofit", "2.9.0"),
    ("okhttp3", "com.squareup.okhttp3", "okhttp", "4.12.0"),
    ("okhttp3.logging", "com.squareup.okhttp3", "logging-interceptor", "4.12.0"),
    ("com.google.gson", "com.google.code.gson", "gson", "2.10.1"),
    ("com.squareup.moshi", "com.squareup.moshi", "moshi", "1.15.0"),
    ("com.bumptech.glide", "com.github.bumptech.glide", "glide", "4.16.0"),
    ("coil", "io.coil-kt", "coil", "2.5.0"),
    ("com.squareup.picasso", "com.squareup.picasso", "picasso", "2.8"),
    ("io.reactivex.rxjava3", "io.reactivex.rxjava3", "rxjava", "3.1.8"),
    ("io.reactivex", "io.reactivex.rxjava2", "rxjava", "2.2.21"),
    ("io.reactivex.rxjava3.android", "io.reactivex.rxjava3", "rxandroid", "3.0.2"),
    ("kotlinx.coroutines", "org.jetbrains.kotlinx", "kotlinx-coroutines-core", "1.7.3"),
    ("kotlinx.coroutines.android", "org.jetbrains.kotlinx", "kotlinx-coroutines-android", "1.7.3"),
    ("dagger", "com.google.dagger", "dagger", "2.50"),
    ("dagger.hilt", "com.google.dagger", "hilt-android", "2.50"),
    ("org.koin", "io.insert-koin", "koin-android", "3.5.3"),
    ("com.google.firebase", "com.google.firebase", "firebase-common", "20.4.2"),
    ("com.google.firebase.analytics", "com.google.firebase", "firebase-analytics", "21.5.0"),
    ("com.google.firebase.crashlytics", "com.google.firebase", "firebase-crashlytics", "18.6.0"),
    ("com.google.firebase.messaging", "com.google.firebase", "firebase-messaging", "23.4.0"),
    ("com.google.firebase.auth", "com.google.firebase", "firebase-auth", "22.3.0"),
    ("com.google.android.gms", "com.google.android.gms", "play-services-base", "18.3.0"),
    ("com.google.android.gms.auth", "com.google.android.gms", "play-services-auth", "20.7.0"),
    ("com.google.android.gms.location", "com.google.android.gms", "play-services-location", "21.1.0"),
    ("com.google.android.gms.maps", "com.google.android.gms", "play-services-maps", "18.2.0"),
    ("timber.log", "com.jakewharton.timber", "timber", "5.0.1"),
    ("leakcanary", "com.squareup.leakcanary", "leakcanary-android", "2.13"),
    ("org.greenrobot.eventbus", "org.greenrobot", "eventbus", "3.3.1"),
    ("com.airbnb.lottie", "com.airbnb.android", "lottie", "6.3.0"),
    ("com.google.android.exoplayer2", "com.google.android.exoplayer", "exoplayer", "2.19.1"),
    ("androidx.media3", "androidx.media3", "media3-exoplayer", "1.2.1"),
    ("com.google.zxing", "com.google.zxing", "core", "3.5.2"),
    ("org.apache.commons.lang3", "org.apache.commons", "commons-lang3", "3.14.0"),
    ("kotlinx.serialization", "org.jetbrains.kotlinx", "kotlinx-serialization-json", "1.6.2"),
    ("androidx.compose.ui", "androidx.compose.ui", "ui", "1.5.4"),
    ("androidx.compose.material3", "androidx.compose.material3", "material3", "1.1.2"),
    ("com.google.accompanist", "com.google.accompanist", "accompanist-systemuicontroller", "0.32.0"),
    ("androidx.paging", "androidx.paging", "paging-runtime", "3.2.1"),
)
#: First-stage prefixes with confidence 0.95: prefix, group, artifact, version.
ANDROIDX = (
    ("androidx.core", "androidx.core", "core-ktx", "1.12.0"),
    ("androidx.appcompat", "androidx.appcompat", "appcompat", "1.6.1"),
    ("androidx.activity", "androidx.activity", "activity-ktx", "1.8.2"),
    ("androidx.fragment", "androidx.fragment", "fragment-ktx", "1.6.2"),
    ("androidx.lifecycle", "androidx.lifecycle", "lifecycle-runtime-ktx", "2.7.0"),
    ("androidx.constraintlayout", "androidx.constraintlayout", "constraintlayout", "2.1.4"),
    ("androidx.recyclerview", "androidx.recyclerview", "recyclerview", "1.3.2"),
    ("androidx.viewpager2", "androidx.viewpager2", "viewpager2", "1.0.0"),
    ("androidx.navigation", "androidx.navigation", "navigation-fragment-ktx", "2.7.6"),
    ("androidx.room", "androidx.room", "room-runtime", "2.6.1"),
    ("androidx.work", "androidx.work", "work-runtime-ktx", "2.9.0"),
    ("androidx.camera", "androidx.camera", "camera-core", "1.3.1"),
    ("androidx.biometric", "androidx.biometric", "biometric", "1.1.0"),
    ("androidx.security", "androidx.security", "security-crypto", "1.1.0-alpha06"),
    ("androidx.datastore", "androidx.datastore", "datastore-preferences", "1.0.0"),
    ("androidx.paging", "androidx.paging", "paging-runtime", "3.2.1"),
    ("androidx.swiperefreshlayout", "androidx.swiperefreshlayout", "swiperefreshlayout", "1.1.0"),
    ("androidx.cardview", "androidx.cardview", "cardview", "1.0.0"),
    ("androidx.compose", "androidx.compose.ui", "ui", "1.5.4"),
    ("androidx.media3", "androidx.media3", "media3-exoplayer", "1.2.1"),
)
THIRD_PARTY = ("com.squareup", "com.jakewharton", "com.github", "com.airbnb", "io.reactivex", "io.coil", "io.insert-koin", "org.greenrobot", "org.apache", "retrofit2", "okhttp3", "okio", "dagger", "timber", "kotlinx", "kotlin")
PLATFORM = ("android.", "java.", "javax.", "kotlin.", "kotlinx.")
#: Well-known classes and their imports.
WELL_KNOWN = (
    ("Bitmap", "android.graphics.Bitmap"), ("Bundle", "android.os.Bundle"), ("Intent", "android.content.Intent"), ("Context", "android.content.Context"),
    ("View", "android.view.View"), ("TextView", "android.widget.TextView"), ("ImageView", "android.widget.ImageView"), ("Activity", "android.app.Activity"),
    ("Fragment", "androidx.fragment.app.Fragment"), ("Log", "android.util.Log"), ("Uri", "android.net.Uri"), ("Handler", "android.os.Handler"), ("Looper", "android.os.Looper"),
)
#: Patterns of code that doesn't parse.
INVALID = (
    r"\(\s*\w+\s*\)\s*[,;]", r"^\s*=\s+[^=]", r"\(\s*\)\s*,", r"\(\s*\w+\s*\)\s*\)",
    r"^\s*\}\s*else\s+if\s*\(", r"\(\s*[+\-*/&|^]\s*\w+\)", r"\(\s*\w+\s*[+\-*/&|^]\s*\)",
)
#: An obfuscated name, as one alternative for each rule.
OBFUSCATED = r"^(?:\p{L}|\p{Ll}{2}|[a-z][0-9]+|[a-z]{1,3}[A-Z]?[0-9]*|[a-z]_[a-z]+|[A-Z][0-9]{2,}[a-z]*)$"
CLASS = r"(?:public\s+)?(?:final\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)"
METHOD = r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\("
KOTLIN_CLASS = r"(?:data\s+|sealed\s+|abstract\s+|open\s+)?(class|object|interface)\s+(\w+)"
#: Second-stage prefixes, specific before general: prefix, group, artifact, version, confidence.
GOOGLE = (
    ("com.google.android.gms.auth", "com.google.android.gms", "play-services-auth", "20.7.0", 0.95),
    ("com.google.android.gms.location", "com.google.android.gms", "play-services-location", "21.1.0", 0.95),
    ("com.google.android.gms.maps", "com.google.android.gms", "play-services-maps", "18.2.0", 0.95),
    ("com.google.android.gms", "com.google.android.gms", "play-services-base", "18.3.0", 0.90),
    ("com.google.firebase.analytics", "com.google.firebase", "firebase-analytics", "21.5.0", 0.95),
    ("com.google.firebase.crashlytics", "com.google.firebase", "firebase-crashlytics", "18.6.0", 0.95),
    ("com.google.firebase.messaging", "com.google.firebase", "firebase-messaging", "23.4.0", 0.95),
    ("com.google.firebase.auth", "com.google.firebase", "firebase-auth", "22.3.0", 0.95),
    ("com.google.firebase", "com.google.firebase", "firebase-common", "20.4.2", 0.90),
)
#: The core library that comes with appcompat: group, artifact, version.
MATERIAL = ("com.google.android.material", "material", "1.11.0")
#: Groups that don't fit the platform, groups that do, and words that rule out the others.
GROUP_BLACKLIST = (
    "org.eclipse", "org.eclipse.core", "org.eclipse.jface", "org.eclipse.ui", "org.eclipse.ecf", "org.eclipse.swt", "org.eclipse.equinox",
    "javax.servlet", "javax.ejb", "javax.jms", "javax.mail", "jakarta.servlet", "jakarta.ejb", "jakarta.jms", "org.openjfx", "javafx",
    "org.springframework", "org.apache.tomcat", "org.apache.catalina", "org.jboss", "org.wildfly", "io.undertow", "org.scala-lang", "org.openmole",
    "com.typesafe.akka", "org.xbib", "net.nemerosa", "com.gitee", "org.qsardb", "org.apache.servicemix", "com.github.nbbrd.sdmx-dl", "com.github.catdou",
    "org.apache.poi", "net.sf.jxls", "org.jxls",
)
GROUP_WHITELIST = (
    "androidx.", "com.google.android", "com.google.firebase", "com.squareup", "io.reactivex", "org.jetbrains.kotlin", "com.jakewharton", "com.github.bumptech", "com.airbnb",
    "io.coil", "com.facebook", "com.google.code.gson", "com.google.dagger", "org.apache.commons", "com.google.zxing", "io.ktor", "org.conscrypt", "com.auth0",
)
GROUP_WORDS = ("eclipse", "swing", "awt", "servlet", "javaee", "javafx")
#: Packages whose files are a library's, themselves and below.
LIBRARY_PACKAGES = (
    "androidx", "com.google.gson", "com.google.firebase", "com.google.android.gms", "com.google.android.material", "com.google.android.exoplayer", "com.google.android.datatransport",
    "com.google.android.play", "com.google.common", "com.google.protobuf", "com.google.crypto.tink", "com.google.errorprone", "com.google.j2objc", "com.google.mlkit", "com.google.zxing",
    "okhttp3", "okhttp", "okio", "retrofit2", "retrofit", "com.squareup.picasso", "com.squareup.moshi", "com.squareup.okhttp", "com.squareup.okio", "com.squareup.leakcanary", "com.squareup.wire",
    "com.bumptech.glide", "coil", "com.github.bumptech.glide", "io.reactivex", "io.reactivex.rxjava2", "io.reactivex.rxjava3", "rx", "rxjava", "kotlin", "kotlinx", "dagger", "hilt",
    "javax.inject", "com.google.dagger", "com.fasterxml.jackson", "org.json", "flexjson", "timber.log", "org.slf4j", "ch.qos.logback", "com.airbnb.lottie", "org.greenrobot.eventbus",
    "org.greenrobot", "butterknife", "org.apache.commons", "org.apache.http", "org.bouncycastle", "org.spongycastle", "jxl", "org.apache.poi", "com.android.volley", "io.realm",
    "org.greenrobot.greendao", "junit", "org.junit", "org.mockito", "io.mockk", "javolution", "net.bytebuddy", "org.jetbrains.annotations", "org.jetbrains", "org.intellij",
    "android.support", "com.facebook", "com.crashlytics", "io.fabric", "com.amplitude", "com.adjust", "com.appsflyer", "com.kakao", "com.nhn", "com.navercorp", "org.krysalis",
    "org.reactivestreams", "org.mospi", "org.apache", "cz.msebera", "io.netty", "io.grpc", "com.squareup", "com.android.installreferrer", "com.android.billingclient", "com.ahnlab",
    "ai.entropyxx", "ai.fairytech", "ai", "firebase", "igj", "net.sourceforge", "com.github", "io.fincube", "io.lfin", "sda", "ocs", "sources", "org.tensorflow",
    "com.google.ai", "org.pytorch", "j$", "android", "android.twb", "com.wizvera", "com.initech", "com.nshc", "com.nice", "com.lguplus", "com.igaworks", "com.enliple", "com.appinsightor",
    "com.atoncorp", "com.callgate", "com.greencross", "com.interezen", "com.journeyapps", "com.ksmartech", "com.mastercard", "com.netfunnel", "com.nethru", "com.nimbusds", "com.oezsoft",
    "com.loopj", "com.gun0912", "com.korks", "com.metsakuur", "com.mww", "com.jakewharton", "com.tmoney", "com.visa", "com.tmx", "com.skt", "com.skp", "com.sktelecom", "com.penta",
    "com.ssenstone", "com.samsung", "com.posicube", "com.seerooinfo", "com.atsoltutions",
)
#: Words that mark a renamed package (p, digits, rest) as a library's.
LIBRARY_WORDS = (
    "rx", "gson", "okhttp", "okio", "retrofit", "glide", "dagger", "hilt", "kotlin", "guava", "proto", "grpc", "firebase", "gms", "play", "volley", "picasso", "moshi", "wire", "room",
    "work", "paging", "lifecycle", "navigation", "compose", "coroutine", "flow",
)
#: Packages of vendors' kits that get stubs, themselves and below.
SDK_PACKAGES = (
    "com.ahnlab", "com.atoncorp", "com.callgate", "com.enliple", "com.greencross", "com.igaworks", "com.initech", "com.interezen", "com.ksmartech", "com.lguplus", "com.mastercard",
    "com.netfunnel", "com.nethru", "com.nice", "com.nimbusds", "com.nshc", "com.penta", "com.posicube", "com.seerooinfo", "com.skt", "com.skp", "com.sktelecom", "com.ssenstone",
    "com.tmoney", "com.tmx", "com.visa", "com.wizvera", "com.google.android.gms.ads", "com.samsung.android.sdk",
)
#: What a decompiler leaves in a file that it could not do in full.
ERROR_MARKERS = ("/* JADX WARN:", "/* JADX ERROR:", "// JADX WARN:", "// JADX ERROR:", "throw new UnsupportedOperationException", "/* Code decompiled incorrectly")
#: Compiler's words that count as invalid code, and those that show it.
INVALID_COUNTED = ("class, interface, enum, or record expected", "illegal start of")
INVALID_SHOWN = ("class, interface, enum, or record expected", "illegal start of expression", "<identifier> expected")
#: A file with so many invalid patterns is dropped.
INVALID_FILE = 50
#: A method's declaration on a trimmed line, and words that rule it out at the start and inside.
METHOD_DECLARATION = r"^(?:public|private|protected|static|final|synchronized|native|abstract|\s)+[\w<>\[\],\s]+\s+\w+\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{"
TYPE_WORDS = ("class ", "interface ", "enum ")
#: Signs of encrypted strings.
STRING_ENCRYPTION = (r"new\s+String\s*\(\s*new\s+byte\s*\[", r"Base64\.decode", r"\.getBytes\s*\(\s*\)\s*\^\s*", r"\^\s*0x[0-9a-fA-F]+")
#: Calls of methods that a decompiler has lost; the first argument of the first kind is a number.
LOST_CALLS = (r"(?<![.\w])([a-z]{2,3})\s*\(\s*(\d+)\s*,([^)]+)\)", r"(?<![.\w])(m[o]?\d+\w*)\s*\(([^)]*)\)")
#: Imports, wildcard imports and fully qualified class names in a file.
SDK_IMPORT = r"import\s+(?:static\s+)?([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)\s*;"
SDK_WILDCARD = r"import\s+([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)\.\*\s*;"
QUALIFIED = r"([a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+)\.([A-Z][a-zA-Z0-9_]*)"
#: Imports by one whole name, constructors with their arguments, and lists of implemented interfaces.
USAGE_IMPORT = r"import\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s*;"
NEW_INSTANCE = r"new\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s*\(([^)]*)\)"
IMPLEMENTS = r"implements\s+([^{]+)"
INTERFACE_NAME = r"^I\p{Lu}|(?:Listener|Callback|Handler|Observer)$"
#: Class in a log line; the first that matches.
LOG_CLASS = (r"class:\s*(\S+)", r"Method\s+(\S+)", r"(\S+\.class)")
#: What a failed sync's output holds and the advice for it; the last two are given where none applies.
SYNC_ADVICE = (
    ("SDK location not found", "Set ANDROID_HOME environment variable"), ("minimum supported Gradle version", "Update Gradle wrapper version"),
    ("Unsupported class file major version", "Update JDK version or change Java compatibility"), ("Could not find", "Check repository configuration in settings.gradle"),
)
SYNC_DEFAULTS = ("Check build.gradle for syntax errors", "Verify Android SDK is installed")
#: Names of platform versions.
SDK_NAMES = {
    21: "5.0 Lollipop", 22: "5.1 Lollipop", 23: "6.0 Marshmallow", 24: "7.0 Nougat", 25: "7.1 Nougat", 26: "8.0 Oreo", 27: "8.1 Oreo", 28: "9 Pie",
    29: "10", 30: "11", 31: "12", 32: "12L", 33: "13", 34: "14", 35: "15",
}
#: Core dependencies of every build after the one that depends on Kotlin.
CORE = ("androidx.appcompat:appcompat:1.6.1", "com.google.android.material:material:1.11.0", "androidx.constraintlayout:constraintlayout:2.1.4")
CORE_KOTLIN, CORE_JAVA = "androidx.core:core-ktx:1.12.0", "androidx.core:core:1.12.0"
#: Dimension rows used where a dimension file is missing or unreadable: name, group, artifact, prefix, version.
BUILT_IN = (
    ("AndroidX Core", "androidx.core", "core-ktx", "androidx.core", "1.12.0"), ("AndroidX AppCompat", "androidx.appcompat", "appcompat", "androidx.appcompat", "1.6.1"),
    ("Material Components", "com.google.android.material", "material", "com.google.android.material", "1.11.0"), ("Retrofit", "com.squareup.retrofit2", "retrofit", "retrofit2", "2.9.0"),
    ("OkHttp", "com.squareup.okhttp3", "okhttp", "okhttp3", "4.12.0"), ("Gson", "com.google.code.gson", "gson", "com.google.gson", "2.10.1"),
    ("Glide", "com.github.bumptech.glide", "glide", "com.bumptech.glide", "4.16.0"), ("RxJava", "io.reactivex.rxjava3", "rxjava", "io.reactivex.rxjava3", "3.1.8"),
    ("Kotlin Coroutines", "org.jetbrains.kotlinx", "kotlinx-coroutines-core", "kotlinx.coroutines", "1.7.3"), ("Dagger", "com.google.dagger", "dagger", "dagger", "2.50"),
    ("Hilt", "com.google.dagger", "hilt-android", "dagger.hilt", "2.50"), ("Firebase Core", "com.google.firebase", "firebase-common", "com.google.firebase", "20.4.2"),
    ("Timber", "com.jakewharton.timber", "timber", "timber.log", "5.0.1"),
)
#: Rows of a report that are shown, by its kind, and characters of a failure's output.
SHOWN = {"permissions": 10, "warnings": 5, "errors": 10, "sync_errors": 3, "unresolved": 5, "compile_errors": 10}
SHOWN_OUTPUT = 500
#: Where sources lie in a project, and the build scripts of which a project has one.
SOURCE_FOLDER = "app/src/main/java"
BUILD_SCRIPTS = ("app/build.gradle", "build.gradle")
#: Settings of a build.
PROPERTIES = (
    ("org.gradle.jvmargs", "-Xmx8192m -Dfile.encoding=UTF-8"), ("org.gradle.parallel", "true"), ("android.useAndroidX", "true"),
    ("kotlin.code.style", "official"), ("android.nonTransitiveRClass", "true"), ("org.gradle.caching", "true"),
)
#: What a project needs to have, files or folders, in the order in which a check names what is missing.
PROJECT_FILES = ("app/build.gradle", "app/src/main/AndroidManifest.xml", "app/src/main/java", "settings.gradle", "gradle.properties")
WRAPPER_FILES = ("gradlew", "gradle/wrapper/gradle-wrapper.properties")
#: The checks of a project: name, message where it passes.
CHECKS = (
    ("Project Structure", "All required files present"), ("Gradle Wrapper", "Gradle wrapper present and executable"), ("Gradle Sync", "Gradle sync successful"),
    ("Dependency Resolution", "All dependencies resolved"), ("Compilation", "Java compilation successful"),
)
UNRESOLVED = "FAILED|Could not resolve|Could not find"
#: What to do about a failed check.
STRUCTURE_ADVICE = ("Ensure all project files were generated correctly",)
WRAPPER_ADVICE = ("Run 'gradle wrapper' in the project directory", "Or copy gradle wrapper from another project")
UNRESOLVED_ADVICE = ("Check dependency versions in build.gradle", "Some libraries may have different artifact names", "Try removing unresolved dependencies")
COMPILE_ADVICE = ("Review decompiled source code for errors", "Some obfuscated code may not compile", "Check for missing imports or dependencies")
